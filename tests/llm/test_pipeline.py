"""The pipeline, stage by stage, against brute force on the stage's own input."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from provlake.llm import queries, toxicity
from tests.llm.test_operators import SCHEMA, brute_components, lower, rows

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage, written and read again."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        at = str(tmp_path_factory.mktemp("stage"))
        stage(spark, docs, DATA).write.mode("overwrite").parquet(at)
        out[name] = docs, spark.read.parquet(at)
        docs = out[name][1]
    return out


def test_all_but_the_last_keep_the_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert before.columns == after.columns, name


def test_toxicity_stage(spark, stages):
    before, after = stages["toxicity"]
    judged = toxicity.judged(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in judged.where("predicted = 0").collect()} and after.count() < before.count()


def test_line_stage(stages):
    before, after = stages["line dedup"]
    before, after = before.collect(), {r.doc_id: r for r in after.collect()}
    pages, lines, hosts, texts = (defaultdict(set) for _ in range(4))
    for r in before:
        pages[r.source].add(r.text)
        for x in r.text.split("\n"):
            lines[r.source, x.strip(" ")].add(r.text)
            if len(x.split()) >= 50:
                hosts[x.strip(" ")].add(r.source)
                texts[x.strip(" ")].add(r.text)
    for r in before:
        often = lambda x, s=r.source: len(lines[s, x]) >= 3 and len(lines[s, x]) > 0.01 * len(pages[s])
        gone = lambda x: x.strip(" ") and (often(x.strip(" ")) or min(len(hosts[x.strip(" ")]), len(texts[x.strip(" ")])) >= 10)
        want = "\n".join(x for x in r.text.split("\n") if not gone(x))
        assert after[r.doc_id].text == want and after[r.doc_id].n_chars == len(want)


def test_near_stage(stages):
    before, after = stages["near-dedup"]
    want = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in before.collect()], 80) if i == c}
    assert {r.doc_id for r in after.collect()} == want and after.count() == len(want) < before.count()


def test_decontamination_stage(spark, stages):
    import re

    before, after = stages["decontamination"]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12)) if w}
    want = set()
    for r in before.collect():
        w = words(r.text)
        hit = {k + i for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for i in range(n)}
        if not (hit and 20 * len(hit) >= len(w)):
            want.add(r.doc_id)
    assert {r.doc_id for r in after.collect()} == want and len(want) < before.count()


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    before, after = stages["packing"]
    tokens = {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect()}
    packed = Counter()
    for r in after.collect():
        packed[r.doc_id] += r.length
    assert packed == Counter(tokens)


def test_stages_on_awkward_and_empty_rows(spark):
    for docs in (spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame([], SCHEMA)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            assert name == "packing" or out.columns == docs.columns
            assert out.count() <= n or name == "packing"


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


CLASHING = ["tokens", "score", "grp", "node", "copies", "component_id", "kept", "predicted", "toxic", "quality", "item_id", "host", "line", "lines", "n", "win", "words", "text_key", "n_shingles", "n_hit", "pos", "col", "key", "value", "id", "ord"]
PLAIN = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [(1, None, "en", "s", 0), (2, "", "en", None, 0), (3, "  \n\n ", None, "s", 4), (4, "one two three four five six seven eight nine ten", "en", "s", 9), (4, "one two three four five six seven eight nine ten", "en", "s", 9), (None, "a text whose id is not known to anyone here at all", "en", "s", 9), (None, None, None, None, None)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_clashing_columns_keep_their_values(spark, name):
    """Columns named as the operators' own ones pass through; nulls stay, and of repeated rows near-dedup alone keeps one."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(AWKWARD, PLAIN)
    for c in CLASHING:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, DATA)
    assert out.columns == docs.columns
    got = out.collect()
    for r in got:
        assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for c in CLASHING)
    ids = Counter(r.doc_id for r in got)
    assert ids == Counter({1: 1, 2: 1, 3: 1, 4: 1 if name == "near-dedup" else 2, None: 2})
    assert next(r for r in got if r.doc_id == 1).text is None


def test_packing_ignores_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(AWKWARD, PLAIN)
    more = docs.withColumns({c: F.lit("x") for c in ("start", "length", "sequence_id", "offset", "ids_crc32", "doc_tokens", *CLASHING)})
    counted = lambda df: Counter((r.doc_id, r.length, r.ids_crc32) for r in corpus_pipeline.pack(spark, df, DATA).collect())
    assert counted(more) == counted(docs) and sum(counted(docs).values()) == 7
