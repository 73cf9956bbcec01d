import subprocess
import sys
from collections import Counter

import numpy as np
import pyarrow as pa

from sieveline.llm import lm

#: Runs a pass's function over three rows, each of which takes 200 MB in blocks that come from the heap, below one
#: that stays, and prints the MB that the process has more afterwards.
HELD = """
import numpy as np, pyarrow as pa
from pyspark.sql.types import LongType, StructField, StructType
from sieveline.llm import common, langid

class Frame:
    columns, schema = ["text"], pa.schema([("text", pa.string())])
    sparkSession = property(lambda self: self)
    sparkContext = property(lambda self: self)
    broadcast = lambda self, x: type("Shared", (), {"value": x})
    mapInArrow = lambda self, run, schema: run

def resident():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6

stays = []
def take(texts):
    blocks = [np.ones(100_000, np.uint8) for _ in range(2_000)]
    stays.append(blocks[-1])
    return blocks

def map_rows():
    StructType.fromDDL = lambda ddl: StructType([StructField("n", LongType())])  # which asks a session

    def start():
        return lambda cols: [[len(take(cols[0]))] * len(cols[0])]
    return common.map_rows(Frame(), start, "n long", rows=1)

def accept():
    langid.Model.predict = lambda self, text: ("en", float(len(take(text)) > 0))
    return langid.accept(Frame(), langid.Model({}))

batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"])], names=["text"])
run, before = %s(), resident()
rows = sum(b.num_rows for b in run(iter([batch])))
print(rows, round(resident() - before))
"""


def held(name):
    said = subprocess.run([sys.executable, "-c", HELD % name], capture_output=True, text=True, timeout=120)
    assert not said.returncode, said.stderr
    return [*map(int, said.stdout.split())]


def test_a_task_gives_its_memory_back():
    for name in ("map_rows", "accept"):
        rows, mb = held(name)
        assert rows == 3 and mb < 60


def test_counts_come_in_small_batches(monkeypatch):
    rnd = np.random.default_rng(2)
    texts = [" ".join(map(str, rnd.integers(0, 400_000, 2_000))) for _ in range(150)] + [None, "a " * 90_000]
    each = [lm.tokens(t) for t in texts]
    want = Counter((False, x) for t in each for x in t.tolist()) + Counter((True, x) for t in each for x in lm.pairs(t).tolist())
    rows = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for combined in (lm.COMBINED, 50_000):  # the last text alone is longer
        monkeypatch.setattr(lm, "COMBINED", combined)
        found, size = Counter(), []
        for batch in lm._counts(iter([rows.slice(0, 70), rows.slice(70)])):
            pair, gram, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for p, g, k in zip(pair.tolist(), gram.view(np.uint64).tolist(), n.tolist()):
                found[p, g] += k
            size.append(batch.num_rows)
        assert found == want and max(size) <= 1 << 16


def test_texts_are_hashed_together_as_one_by_one(monkeypatch):
    rnd = np.random.default_rng(3)
    words = ["a", "Bb", "word", "x" * 70, "\u00c4\u00e9", "longer-than-eight", "1"]
    texts = [("\t " if i % 3 else "").join(w + rnd.choice([" ", "\n", "\x0b  "]) for w in rnd.choice(words, i % 40)) for i in range(500)] + [None, "", " ", "\u00a0", None]
    each = [lm.tokens(t) for t in texts]
    for together in (lm.TOGETHER, 1, 100):
        monkeypatch.setattr(lm, "TOGETHER", together)
        t, size = lm.tokens_of(texts)
        assert size.tolist() == [*map(len, each)] and t.tolist() == np.concatenate(each).tolist()
    assert [x.tolist() for x in lm.tokens_of([])] == [[], []]
