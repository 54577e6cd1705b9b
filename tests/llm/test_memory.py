"""What the corpus operators' workers hold at once."""

from __future__ import annotations

import glob
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandlake.llm import components, jaccard, lm_score, ppm, quality


def chunk():
    random.seed(4)
    words = ["".join(random.choices("abcdefghijklmnop", k=random.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(random.choices(words, k=300)).encode() for _ in range(2000)]
    return pa.table({"doc": [str(i) for i in range(2000)], "data": texts, "learn": [i % 7 != 2 for i in range(2000)]})


def test_lm_score_packs_in_slices(monkeypatch):
    """Grams of a chunk are summed as they come: before, all slices' were held, about 20 times the text."""
    monkeypatch.setattr(lm_score, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    table = chunk()
    tracemalloc.start()
    rows = sum(b.num_rows for b in lm_score._packed(iter(table.to_batches(500))))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 100_000 and most < 13 * table["data"].nbytes


def test_lm_score_slices_change_nothing(monkeypatch):
    table = chunk().slice(0, 60)
    texts, learn = table["data"].to_pylist(), table["learn"].to_pylist()
    want: Counter = Counter()
    for t, use in zip(texts, learn, strict=True):
        keys = [lm_score.word_key(w) for w in t.split()] + ppm.grams([t], lm_score.ORDER)[0].tolist()
        for k in keys:
            want[k] += use
    for size in (1, 5000, 1 << 30):
        monkeypatch.setattr(lm_score, "BATCH_BYTES", size)
        keys, counts = lm_score._chunk_keys(table)
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == dict(want)
        sizes = [len(t) for t, _, _ in lm_score._batches(table)]
        assert sum(sizes) == 60 and (size > 1 or set(sizes) == {1})
    empty = table.slice(0, 0)
    assert [len(x) for x in lm_score._chunk_keys(empty)] == [0, 0] and not list(lm_score._batches(empty))
    assert np.all(np.diff(keys) > 0) and pc.sum(table["learn"]).as_py() == sum(learn)


def test_encoder_leaves_the_worker_to_other_operators():
    """The same workers run all stages: before, the model and its tables stayed in them for good."""
    import corpus_pipeline
    from strandlake.llm import common, pieces

    model = open(corpus_pipeline.tokenizer_path(), "rb").read()
    use = pieces.encoder(model)
    text = "naïve  words, unbelievably reworded: zzzyxq qqqwrt 12 345\nnext line"
    said = use.coded(text)
    use.forget()
    assert not use.pairs and not any(use.edges) and use.coded(text) == said
    common.release_memory(pieces._LOADED)
    assert pieces.encoder(model) is use
    common.release_memory()
    assert not pieces._LOADED and pieces.encoder(model).coded(text) == said


def test_small_tables_are_few_files(spark, monkeypatch):
    """Each file forks the executor, whose memory counts twice for that moment: before, 50 files for a few rows each."""
    files: dict[str, list[int]] = {"jaccard": [], "components": [], "quality": []}

    def counting(module, write):
        def run(df):
            out = write(df)
            files[module].append(len(glob.glob(out._strandlake_path.removeprefix("file:") + "/part-*")))
            return out

        return run

    for module in (jaccard, components, quality):
        name = module.__name__.rsplit(".", 1)[1]
        monkeypatch.setattr(module, "written", counting(name, module.written))
    random.seed(5)
    words = ["".join(random.choices("abcdefgh", k=6)) for _ in range(300)]
    rows = []
    for i in range(60):
        copy = words[:120]
        copy[i * 2] = "changed"
        rows.append((i, " ".join(copy), "en"))
    rows += [(100 + i, " ".join(random.choices(words, k=50)), "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    names = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        kept = {r["doc_id"] for r in jaccard.one_of_each(df).collect()}
        quality.kept_rows(df).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert kept == {0, *range(100, 140)}
    assert len(files["components"]) >= 4 and len(files["quality"]) >= 2
    assert max(map(max, files.values())) <= 3
