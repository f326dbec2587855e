"""The pipeline's stages on edge rows, and shared folders of sessions without a checkpoint folder."""

import random
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from gatehouse.llm import common, packing, pseudonyms  # noqa: E402


def tables(spark, folder, rows, labels):
    docs = [(i, t, "en", "web", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def brute(rows):
    """What must be left: clean, one of each group of near copies, without personal data, packed whole."""
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    clean = [(i, t) for i, t in rows if "grumpf" not in (t or "")]
    parent = {i: i for i, _ in clean if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in clean:
        for j, b in clean:
            a_, b_ = shingles(a), shingles(b)
            if i is not None and j is not None and a_ and b_ and 100 * len(a_ & b_) >= 80 * len(a_ | b_):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    kept = [(i, t) for i, t in clean if i is None or find(i) == i]
    encoder = packing.WordEncoder(packing.WORD_BPE)
    return Counter((i, len(encoder.encode_many([pseudonyms.Pseudonymizer().replace(t)[0] or ""])[0]) + 1) for i, t in kept)


def test_pipeline_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    rows, labels = [], []
    for k in range(300):
        text = [r.choice(words) for _ in range(40)] + (["grumpf"] if k % 4 == 0 else [])
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(k % 4 == 0)))
    rows += [(1000 + k, f"{rows[k][1]} more") for k in range(40, 60)] + [(2000, "ask иван@example.com or 8.8.8.8"), (2001, None), (2002, ""), (None, "no id"), (None, None), rows[1], (2003, "w " * 5000)]
    tables(spark, f"file://{tmp_path}/in", rows, [*labels, (None, None, None), (2001, 1, 0)])
    out = corpus_pipeline.run(spark, f"file://{tmp_path}/in")
    got = Counter()
    for x in out.groupBy("doc_id", "start").count().join(out, ["doc_id", "start"]).collect():
        assert x.length <= packing.CAPACITY
    whole = Counter()
    for x in out.collect():
        got[x.doc_id] += x.length
        whole[x.doc_id] += x.piece == 0
    want = brute(rows)
    lengths = Counter()
    for (i, n), times in want.items():
        lengths[i] += n * times
    assert got == lengths and whole == Counter({i: sum(c for (j, _), c in want.items() if j == i) for i in lengths})
    assert len(list((tmp_path / "shared").glob("pipeline-*/[0-9]*"))) == 1


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    tables(spark, f"file://{tmp_path}", [], [])
    docs = common.read_table(spark, f"file://{tmp_path}", "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_folder_without_a_setting(spark, monkeypatch):
    class Unset:
        def __init__(self, conf):
            self.conf = conf

        def get(self, key, *default):
            return None if key == "spark.checkpoint.dir" else self.conf.get(key, *default)

        def set(self, *pair):
            self.conf.set(*pair)

    conf = spark.conf
    monkeypatch.setattr(type(spark), "conf", property(lambda _: Unset(conf)))
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = common.shared_folder(spark)
    assert folder == given.get() if given.isDefined() else folder.startswith(conf.get("spark.sql.warehouse.dir"))
    scratch = common.Scratch(spark, "test")
    kept = scratch.keep(spark.range(5).toDF("x"))
    assert kept.count() == 5
    scratch.clear()
