"""From source to findings."""

from __future__ import annotations

import pytest

from factloom.extract.python_facts import extract
from factloom.plans import rules
from factloom.plans.catalogue import built_in
from factloom.plans.repo import Repo

APP = '''
from flask import Flask, request, redirect
from flask_login import login_required
from flask_sqlalchemy import SQLAlchemy
from .store import save
app = Flask(__name__)
db = SQLAlchemy(app)

@app.route("/open", methods=["POST", "GET"])
def open_write():
    save(request.form)

@app.post("/closed")
@login_required
def closed_write():
    save(request.json)

@app.get("/go")
def go():
    return redirect(request.args["to"])
'''
STORE = '''
from flask_sqlalchemy import SQLAlchemy
db = SQLAlchemy()

def save(row):
    db.session.add(row)
'''


@pytest.fixture(scope="module")
def repo(spark):
    files = spark.createDataFrame([("shop/app.py", APP), ("shop/store.py", STORE), ("shop/bad.py", "def (")], "file string, source string")
    return Repo(extract(files), built_in(spark))


def test_relations(repo):
    assert {(r["path"], tuple(r["methods"]), r["handler"]) for r in repo.routes.collect()} == {("/open", ("GET", "POST"), "shop.app.open_write"), ("/closed", ("POST",), "shop.app.closed_write"), ("/go", ("GET",), "shop.app.go")}
    assert {(r["src"], r["dst"]) for r in repo.call_edges.collect()} == {("shop.app.open_write", "shop.store.save"), ("shop.app.closed_write", "shop.store.save")}
    assert {(r["function"], r["detail"]) for r in repo.effects.collect()} == {("shop.store.save", "db_write")}
    assert {(r["function"], r["detail"]) for r in repo.reads.collect()} == {("shop.app.open_write", "form"), ("shop.app.closed_write", "json"), ("shop.app.go", "query")}
    assert [r["kind"] for r in repo.gaps.collect()] == ["parse"]


def test_findings(repo):
    found = rules.run(repo, rules.chosen(exclude=["endpoints"]))
    got = {(r["rule_id"], r["summary"]) for r in found.collect()}
    assert got == {
        ("unguarded-writes", "no check before a write in shop.app.open_write"),
        ("input-near-sink", "query input beside a redirect sink"),
        ("request-inputs", "1x form"),
        ("request-inputs", "1x json"),
        ("request-inputs", "1x query"),
        ("route-guards", "authentication"),
    }
    assert rules.exit_code(found, "high") == 1 and rules.exit_code(found, "critical") == 0 and rules.exit_code(found, "low", complete=False) == 124


def test_registry():
    with pytest.raises(ValueError):
        rules.detector("endpoints", "info", "again")(lambda repo: repo.routes)
    with pytest.raises(ValueError):
        rules.detector("x", "odd", "no such severity")
    assert [d.rule_id for d in rules.chosen(["*s"], ["r*"])] == ["endpoints", "unguarded-writes"]
