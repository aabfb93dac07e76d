"""What a Python worker holds: the pipeline's executors have little memory beside their heap."""

import subprocess
import sys
from pathlib import Path

import pytest

WORKER = """
import random, re
from pathlib import Path
import pyarrow as pa
import public_tokenizers
from factloom.llm import packing
from factloom.llm.common import tidy

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

chance = random.Random(1)
words = ["".join(chance.choices("abcdefghijklmnopqrstuvwxyz", k=chance.randint(2, 9))) for _ in range(30000)]
texts = [" ".join(w + chance.choice(("", ",", ".", "s", "(1)", "-x")) for w in chance.choices(words, k=600)) for _ in range(1024)]
batches = [pa.record_batch([pa.array(texts[k:] + texts[:k])], ["text"]) for k in (0, 300, 600)]
del texts, words
before, most = held(), 0

def run(given):
    made = packing.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for batch in given:
        made.ids_of(batch.column(0))
        yield batch

for _ in tidy(run)(iter(batches)):
    most = max(most, held() - before)
print(round(most))
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="reads Linux's figures")
def test_a_packing_worker_holds_little():
    made = subprocess.run([sys.executable, "-c", WORKER], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=300)
    assert made.returncode == 0, made.stderr
    assert int(made.stdout) < 60, f"{made.stdout} MB"
