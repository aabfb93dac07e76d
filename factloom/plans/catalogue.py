"""The built-in pattern dimension: what well-known libraries' names mean. A small curated set; users add rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "pattern int, provider string, library string, kind string, fqn string, gives string, detail string"

#: Provider, library, kind of fact, qualified name, what a match gives, its detail.
ROWS = (
    ("flask", "flask", "decorator", "flask.Flask.route", "route", "GET"),
    ("flask", "flask", "decorator", "flask.Flask.get", "route", "GET"),
    ("flask", "flask", "decorator", "flask.Flask.post", "route", "POST"),
    ("flask", "flask", "decorator", "flask.Flask.put", "route", "PUT"),
    ("flask", "flask", "decorator", "flask.Flask.delete", "route", "DELETE"),
    ("flask", "flask", "decorator", "flask.Blueprint.route", "route", "GET"),
    ("flask", "flask", "decorator", "flask.Flask.before_request", "hook", "before"),
    ("flask", "flask", "attribute", "flask.request.args", "input", "query"),
    ("flask", "flask", "attribute", "flask.request.form", "input", "form"),
    ("flask", "flask", "attribute", "flask.request.json", "input", "json"),
    ("flask", "flask", "attribute", "flask.request.headers", "input", "header"),
    ("flask", "flask", "attribute", "flask.request.cookies", "input", "cookie"),
    ("flask", "flask", "call", "flask.redirect", "sink", "redirect"),
    ("flask", "flask", "call", "flask.render_template_string", "sink", "template"),
    ("flask", "flask", "call", "flask.abort", "check", "denial"),
    ("fastapi", "fastapi", "decorator", "fastapi.FastAPI.get", "route", "GET"),
    ("fastapi", "fastapi", "decorator", "fastapi.FastAPI.post", "route", "POST"),
    ("fastapi", "fastapi", "decorator", "fastapi.FastAPI.delete", "route", "DELETE"),
    ("flask-login", "flask_login", "decorator", "flask_login.login_required", "check", "authentication"),
    ("flask-login", "flask_login", "call", "flask_login.login_user", "effect", "session_write"),
    ("flask-sqlalchemy", "flask_sqlalchemy", "call", "flask_sqlalchemy.SQLAlchemy.session.add", "effect", "db_write"),
    ("flask-sqlalchemy", "flask_sqlalchemy", "call", "flask_sqlalchemy.SQLAlchemy.session.delete", "effect", "db_delete"),
    ("flask-sqlalchemy", "flask_sqlalchemy", "call", "flask_sqlalchemy.SQLAlchemy.session.execute", "sink", "sql"),
    ("requests", "requests", "call", "requests.get", "effect", "outbound"),
    ("requests", "requests", "call", "requests.post", "effect", "outbound"),
    ("pyjwt", "jwt", "call", "jwt.decode", "check", "token"),
    ("stdlib", "os", "call", "os.system", "sink", "command"),
    ("stdlib", "os", "call", "os.remove", "effect", "file_delete"),
    ("stdlib", "subprocess", "call", "subprocess.run", "sink", "command"),
    ("stdlib", "hmac", "call", "hmac.compare_digest", "check", "comparison"),
    ("django", "django", "decorator", "django.contrib.auth.decorators.login_required", "check", "authentication"),
    ("django", "django", "decorator", "django.contrib.auth.decorators.permission_required", "check", "authorization"),
    ("django", "django", "decorator", "django.contrib.auth.decorators.user_passes_test", "check", "authorization"),
    ("django", "django", "decorator", "django.views.decorators.csrf.csrf_exempt", "exemption", "csrf"),
    ("django", "django", "decorator", "django.views.decorators.http.require_POST", "check", "method"),
    ("django", "django", "call", "django.contrib.auth.login", "effect", "session_write"),
    ("django", "django", "call", "django.contrib.auth.logout", "effect", "session_delete"),
    ("django", "django", "call", "django.shortcuts.redirect", "sink", "redirect"),
    ("django", "django", "call", "django.utils.safestring.mark_safe", "sink", "html"),
    ("django", "django", "call", "django.utils.http.url_has_allowed_host_and_scheme", "check", "url"),
    ("django", "django", "call", "django.core.cache.cache.set", "effect", "cache_write"),
    ("django", "django", "call", "django.core.cache.cache.delete", "effect", "cache_delete"),
    ("django", "django", "call", "django.core.mail.send_mail", "effect", "outbound"),
    ("djangorestframework", "rest_framework", "decorator", "rest_framework.decorators.api_view", "route", "GET"),
    ("djangorestframework", "rest_framework", "decorator", "rest_framework.decorators.permission_classes", "check", "authorization"),
    ("fastapi", "fastapi", "decorator", "fastapi.FastAPI.put", "route", "PUT"),
    ("fastapi", "fastapi", "decorator", "fastapi.FastAPI.patch", "route", "PATCH"),
    ("fastapi", "fastapi", "decorator", "fastapi.APIRouter.get", "route", "GET"),
    ("fastapi", "fastapi", "decorator", "fastapi.APIRouter.post", "route", "POST"),
    ("fastapi", "fastapi", "decorator", "fastapi.APIRouter.put", "route", "PUT"),
    ("fastapi", "fastapi", "decorator", "fastapi.APIRouter.delete", "route", "DELETE"),
    ("fastapi", "fastapi", "decorator", "fastapi.FastAPI.middleware", "hook", "around"),
    ("fastapi", "fastapi", "call", "fastapi.responses.RedirectResponse", "sink", "redirect"),
    ("starlette", "starlette", "call", "starlette.responses.RedirectResponse", "sink", "redirect"),
    ("starlette", "starlette", "decorator", "starlette.authentication.requires", "check", "authorization"),
    ("quart", "quart", "decorator", "quart.Quart.route", "route", "GET"),
    ("quart", "quart", "decorator", "quart.Quart.post", "route", "POST"),
    ("sanic", "sanic", "decorator", "sanic.Sanic.get", "route", "GET"),
    ("sanic", "sanic", "decorator", "sanic.Sanic.post", "route", "POST"),
    ("bottle", "bottle", "decorator", "bottle.route", "route", "GET"),
    ("bottle", "bottle", "decorator", "bottle.post", "route", "POST"),
    ("bottle", "bottle", "attribute", "bottle.request.query", "input", "query"),
    ("bottle", "bottle", "attribute", "bottle.request.forms", "input", "form"),
    ("flask", "flask", "decorator", "flask.Flask.patch", "route", "PATCH"),
    ("flask", "flask", "decorator", "flask.Blueprint.get", "route", "GET"),
    ("flask", "flask", "decorator", "flask.Blueprint.post", "route", "POST"),
    ("flask", "flask", "decorator", "flask.Blueprint.put", "route", "PUT"),
    ("flask", "flask", "decorator", "flask.Blueprint.delete", "route", "DELETE"),
    ("flask", "flask", "decorator", "flask.Blueprint.before_request", "hook", "before"),
    ("flask", "flask", "decorator", "flask.Flask.after_request", "hook", "after"),
    ("flask", "flask", "attribute", "flask.request.values", "input", "query"),
    ("flask", "flask", "attribute", "flask.request.files", "input", "file"),
    ("flask", "flask", "attribute", "flask.request.data", "input", "body"),
    ("flask", "flask", "call", "flask.request.get_json", "input", "json"),
    ("flask", "flask", "call", "flask.request.get_data", "input", "body"),
    ("flask", "flask", "call", "flask.send_file", "sink", "path"),
    ("flask", "flask", "call", "flask.Markup", "sink", "html"),
    ("flask-login", "flask_login", "decorator", "flask_login.fresh_login_required", "check", "authentication"),
    ("flask-login", "flask_login", "call", "flask_login.logout_user", "effect", "session_delete"),
    ("flask-jwt-extended", "flask_jwt_extended", "decorator", "flask_jwt_extended.jwt_required", "check", "authentication"),
    ("flask-jwt-extended", "flask_jwt_extended", "call", "flask_jwt_extended.verify_jwt_in_request", "check", "authentication"),
    ("flask-httpauth", "flask_httpauth", "decorator", "flask_httpauth.HTTPBasicAuth.login_required", "check", "authentication"),
    ("flask-limiter", "flask_limiter", "decorator", "flask_limiter.Limiter.limit", "check", "rate"),
    ("flask-limiter", "flask_limiter", "decorator", "flask_limiter.Limiter.exempt", "exemption", "rate"),
    ("flask-wtf", "flask_wtf", "decorator", "flask_wtf.csrf.CSRFProtect.exempt", "exemption", "csrf"),
    ("flask-mail", "flask_mail", "call", "flask_mail.Mail.send", "effect", "outbound"),
    ("flask-caching", "flask_caching", "call", "flask_caching.Cache.set", "effect", "cache_write"),
    ("flask-sqlalchemy", "flask_sqlalchemy", "call", "flask_sqlalchemy.SQLAlchemy.session.merge", "effect", "db_write"),
    ("flask-sqlalchemy", "flask_sqlalchemy", "call", "flask_sqlalchemy.SQLAlchemy.session.commit", "effect", "db_write"),
    ("sqlalchemy", "sqlalchemy", "call", "sqlalchemy.text", "sink", "sql"),
    ("sqlalchemy", "sqlalchemy", "call", "sqlalchemy.orm.Session.add", "effect", "db_write"),
    ("sqlalchemy", "sqlalchemy", "call", "sqlalchemy.orm.Session.delete", "effect", "db_delete"),
    ("sqlalchemy", "sqlalchemy", "call", "sqlalchemy.orm.Session.commit", "effect", "db_write"),
    ("pymongo", "pymongo", "call", "pymongo.MongoClient.insert_one", "effect", "db_write"),
    ("pymongo", "pymongo", "call", "pymongo.MongoClient.delete_one", "effect", "db_delete"),
    ("redis", "redis", "call", "redis.Redis.set", "effect", "cache_write"),
    ("redis", "redis", "call", "redis.Redis.delete", "effect", "cache_delete"),
    ("redis", "redis", "call", "redis.Redis.get", "effect", "cache_read"),
    ("requests", "requests", "call", "requests.put", "effect", "outbound"),
    ("requests", "requests", "call", "requests.delete", "effect", "outbound"),
    ("requests", "requests", "call", "requests.request", "effect", "outbound"),
    ("httpx", "httpx", "call", "httpx.get", "effect", "outbound"),
    ("httpx", "httpx", "call", "httpx.post", "effect", "outbound"),
    ("httpx", "httpx", "call", "httpx.AsyncClient.get", "effect", "outbound"),
    ("pyjwt", "jwt", "call", "jwt.encode", "effect", "token_write"),
    ("python-jose", "jose", "call", "jose.jwt.decode", "check", "token"),
    ("itsdangerous", "itsdangerous", "call", "itsdangerous.URLSafeTimedSerializer.loads", "check", "token"),
    ("bcrypt", "bcrypt", "call", "bcrypt.checkpw", "check", "comparison"),
    ("passlib", "passlib", "call", "passlib.hash.bcrypt.verify", "check", "comparison"),
    ("werkzeug", "werkzeug", "call", "werkzeug.security.check_password_hash", "check", "comparison"),
    ("pyotp", "pyotp", "call", "pyotp.TOTP.verify", "check", "token"),
    ("marshmallow", "marshmallow", "call", "marshmallow.Schema.load", "check", "schema"),
    ("jsonschema", "jsonschema", "call", "jsonschema.validate", "check", "schema"),
    ("bleach", "bleach", "call", "bleach.clean", "check", "html"),
    ("stdlib", "subprocess", "call", "subprocess.Popen", "sink", "command"),
    ("stdlib", "subprocess", "call", "subprocess.check_output", "sink", "command"),
    ("stdlib", "os", "call", "os.popen", "sink", "command"),
    ("stdlib", "os", "call", "os.rename", "effect", "file_write"),
    ("stdlib", "shutil", "call", "shutil.rmtree", "effect", "file_delete"),
    ("stdlib", "pickle", "call", "pickle.loads", "sink", "deserialise"),
    ("stdlib", "sqlite3", "call", "sqlite3.connect", "effect", "db_read"),
    ("stdlib", "urllib", "call", "urllib.request.urlopen", "effect", "outbound"),
    ("pyyaml", "yaml", "call", "yaml.load", "sink", "deserialise"),
    ("jinja2", "jinja2", "call", "jinja2.Template", "sink", "template"),
    ("argon2-cffi", "argon2", "call", "argon2.PasswordHasher.verify", "check", "comparison"),
    ("authlib", "authlib", "call", "authlib.jose.jwt.decode", "check", "token"),
    ("cryptography", "cryptography", "call", "cryptography.fernet.Fernet.decrypt", "check", "token"),
    ("defusedxml", "defusedxml", "call", "defusedxml.ElementTree.parse", "check", "xml"),
    ("defusedxml", "defusedxml", "call", "defusedxml.ElementTree.fromstring", "check", "xml"),
    ("django-allauth", "allauth", "decorator", "allauth.account.decorators.verified_email_required", "check", "authentication"),
    ("django-cors-headers", "corsheaders", "call", "corsheaders.signals.check_request_enabled.connect", "exemption", "origin"),
    ("falcon", "falcon", "decorator", "falcon.before", "hook", "before"),
    ("falcon", "falcon", "decorator", "falcon.after", "hook", "after"),
    ("falcon", "falcon", "call", "falcon.HTTPForbidden", "check", "denial"),
    ("falcon", "falcon", "call", "falcon.HTTPUnauthorized", "check", "denial"),
    ("flask-allows", "flask_allows", "decorator", "flask_allows.requires", "check", "authorization"),
    ("flask-cors", "flask_cors", "decorator", "flask_cors.cross_origin", "exemption", "origin"),
    ("flask-restful", "flask_restful", "call", "flask_restful.abort", "check", "denial"),
    ("flask-restful", "flask_restful", "call", "flask_restful.reqparse.RequestParser.parse_args", "input", "json"),
    ("flask-restx", "flask_restx", "call", "flask_restx.abort", "check", "denial"),
    ("flask-restx", "flask_restx", "call", "flask_restx.reqparse.RequestParser.parse_args", "input", "json"),
    ("flask-session", "flask_session", "call", "flask_session.Session", "effect", "config_write"),
    ("flask-talisman", "flask_talisman", "call", "flask_talisman.Talisman", "check", "headers"),
    ("litestar", "litestar", "decorator", "litestar.get", "route", "GET"),
    ("litestar", "litestar", "decorator", "litestar.post", "route", "POST"),
    ("litestar", "litestar", "decorator", "litestar.put", "route", "PUT"),
    ("litestar", "litestar", "decorator", "litestar.patch", "route", "PATCH"),
    ("litestar", "litestar", "decorator", "litestar.delete", "route", "DELETE"),
    ("oauthlib", "oauthlib", "call", "oauthlib.oauth2.WebApplicationClient.parse_request_body_response", "input", "claims"),
    ("peewee", "peewee", "call", "peewee.Model.create", "effect", "db_write"),
    ("peewee", "peewee", "call", "peewee.Model.save", "effect", "db_write"),
    ("peewee", "peewee", "call", "peewee.Model.delete_instance", "effect", "db_delete"),
    ("peewee", "peewee", "call", "peewee.SQL", "sink", "sql"),
    ("psycopg2", "psycopg2", "call", "psycopg2.connect", "effect", "db_read"),
    ("psycopg2", "psycopg2", "call", "psycopg2.extensions.cursor.execute", "sink", "sql"),
    ("pycasbin", "casbin", "call", "casbin.Enforcer.enforce", "check", "authorization"),
    ("pydantic", "pydantic", "call", "pydantic.BaseModel.model_validate", "check", "schema"),
    ("pydantic", "pydantic", "call", "pydantic.TypeAdapter.validate_python", "check", "schema"),
    ("pymysql", "pymysql", "call", "pymysql.connect", "effect", "db_read"),
    ("pymysql", "pymysql", "call", "pymysql.cursors.Cursor.execute", "sink", "sql"),
    ("pyramid", "pyramid", "decorator", "pyramid.view.view_config", "route", "GET"),
    ("pyramid", "pyramid", "call", "pyramid.httpexceptions.HTTPForbidden", "check", "denial"),
    ("pyramid", "pyramid", "call", "pyramid.httpexceptions.HTTPFound", "sink", "redirect"),
    ("secure-py", "secure", "call", "secure.Secure", "check", "headers"),
    ("sqlmodel", "sqlmodel", "call", "sqlmodel.Session.add", "effect", "db_write"),
    ("sqlmodel", "sqlmodel", "call", "sqlmodel.Session.delete", "effect", "db_delete"),
    ("sqlmodel", "sqlmodel", "call", "sqlmodel.text", "sink", "sql"),
    ("tornado", "tornado", "decorator", "tornado.web.authenticated", "check", "authentication"),
    ("tornado", "tornado", "call", "tornado.web.RequestHandler.get_argument", "input", "query"),
    ("tornado", "tornado", "call", "tornado.web.RequestHandler.get_body_argument", "input", "form"),
    ("tornado", "tornado", "call", "tornado.web.RequestHandler.get_cookie", "input", "cookie"),
    ("tornado", "tornado", "call", "tornado.web.RequestHandler.redirect", "sink", "redirect"),
)


def built_in(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *r) for n, r in enumerate(ROWS)], SCHEMA)
