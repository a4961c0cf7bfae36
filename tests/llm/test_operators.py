"""The operators against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from provlake.llm import decontamination, importance, interpolation, near_duplicates, packing, pseudonyms, queries, rules_list, site_lines, toxicity, url_rules

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, node string, score double"
WORDS = [f"w{i}" for i in range(60)] + ["the", "of", "é", "ß1", "Big", "UP"]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows():
    """Documents with nulls, blanks, copies, repeats, one very long text, and columns that clash."""
    rng = random.Random(7)
    base = [text(rng, rng.choice([1, 3, 8, 40, 120])) for _ in range(40)]
    near = []
    for i in range(12):  # near copies of one text
        w = base[5].split() if len(base[5].split()) > 30 else text(rng, 90).split()
        base[5] = " ".join(w)
        w = list(w)
        for _ in range(i % 3):
            w[rng.randrange(len(w))] = f"edit{i}"
        near.append(" ".join(w))
    texts = base + near + [base[3]] * 4 + [None, "", "  \n\t ", "a b", "a b", text(rng, 20_000)]
    out = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or ""), True, "x", 0.5) for i, t in enumerate(texts)]
    return out + [out[2], out[2], (None, base[6], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).coalesce(2)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 > 0), int(i % 6 == 0)) for i in range(50)] + [(None, 1, 1), (51, None, None)], "doc_id long, quality int, toxic int")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def counted(xs):
    return Counter(map(str, xs))


# --- 1


def test_importance_keeps_what_is_like_the_target(spark):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(50))) for i in range(60)]
    bad = [(100 + i, " ".join(rng.choice(["x", "y", "z"]) for _ in range(50))) for i in range(40)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string")
    out = importance.resample(d, spark.createDataFrame([(i,) for i in range(30)], "doc_id long"), keep=0.6).toPandas()
    assert out.kept.sum() == 60 and set(out[out.kept].doc_id) == {i for i, _ in good}


def test_importance_takes_exactly_the_top_k(spark, docs, labels):
    out = importance.resample(docs, labels.where("quality = 1"), keep=0.5).toPandas()
    k = round(0.5 * len(out))
    want = out.sort_values(["gumbel_key", "doc_id"], ascending=[False, True]).head(k)
    assert out[out.kept].gumbel_key.min() == want.gumbel_key.min() and k <= out.kept.sum() <= k + 3
    assert (out[out.doc_id.isin([56, 57])].log_weight == 0).all()


def test_kth_largest_with_ties(spark):
    d = spark.createDataFrame([(i, float(i // 5000)) for i in range(20_000)], "doc_id long, gumbel_key double")
    assert importance.kth_largest(d, "gumbel_key", "doc_id", 7_003) == (2.0, 12_002)
    assert importance.kth_largest(d, "gumbel_key", "doc_id", 20_000)[0] == float("-inf")


# --- 2


def test_interpolation_base_and_counts(docs):
    out = interpolation.scored(docs).toPandas()
    source = [(r[0], r[1]) for r in rows()]
    fold = lambda i: -1 if i is None else zlib.crc32(str(i).encode()) % 7
    c = Counter(w for i, t in source if fold(i) != 2 for w in [*spaced(t), None])
    n, v = sum(c.values()), len(c)
    want = counted((i, fold(i) == 2, len(spaced(t)) + 1, sum(c[w] > 0 for w in [*spaced(t), None]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*spaced(t), None]), 6)) for i, t in source)
    got = counted((None if x.doc_id != x.doc_id else int(x.doc_id), bool(x.held_out), x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in out.itertuples())
    assert got == want


def test_interpolation_is_the_mixture(spark):
    """Scores equal the formula under the learnt weights, and weights are those of the bins."""
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    out = interpolation.scored(d).toPandas().set_index("doc_id")
    source = {r.doc_id: spaced(r.text) + [None] for r in d.collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 7

    def counts(keep):
        one, two = Counter(), Counter()
        for i, w in source.items():
            if keep(fold(i)):
                one.update(w)
                one["<s>"] += 1
                two.update(zip(["<s>", *w[:-1]], w, strict=True))
        return one, two, sum(one.values()) - one["<s>"], len(one) - 1

    one, two, n, v = counts(lambda f: f not in (2, 3))
    bins = Counter()
    for i, w in source.items():
        if fold(i) == 3:
            for h, x in zip(["<s>", *w[:-1]], w, strict=True):
                b = 0 if not one[h] else min(int(math.log2(one[h])) + 1, interpolation.CONTEXT_BUCKETS - 1)
                q = lambda a: round(interpolation.STEP * math.log2(a)) if a else float("nan")
                bins[(b, q(one[x] / n), q(two[(h, x)] / one[h] if one[h] else 0))] += 1
    import numpy as np

    weights = interpolation.learn(np.array([[*k, m] for k, m in bins.items()], dtype=float), v)
    one, two, n, v = counts(lambda f: f != 2)
    for i, w in list(source.items())[:40]:
        total = 0.0
        for h, x in zip(["<s>", *w[:-1]], w, strict=True):
            a = weights[0 if not one[h] else min(int(math.log2(one[h])) + 1, interpolation.CONTEXT_BUCKETS - 1)]
            total += math.log10(a[0] / (v + 1) + a[1] * one[x] / n + (a[2] * two[(h, x)] / one[h] if one[h] else 0))
        assert out.score[i] == pytest.approx(total, rel=1e-6)
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_interpolation_empty(empty):
    assert interpolation.scored(empty).count() == 0


# --- 3


def test_site_lines_awkward_rows(spark, empty):
    d = [(i, f"Shared line\nown {i}\n  Shared line \n\nend", "s") for i in range(10)] + [(i, f"Rare\nown {i}", "t") for i in range(20, 23)]
    d += [(90, None, "s"), (91, "", "s"), (92, "Shared line", None)] + [(93, "copied\npage", "u")] * 40
    made = spark.createDataFrame(d, "doc_id long, text string, source string")
    by = {r.doc_id: r for r in site_lines.dropped(made).collect()}
    assert by[21].text == "own 21" and by[3].text == "own 3\n" and by[93].text == "copied\npage"  # three pages of three; rows of one id and text are one page
    out = site_lines.dropped(made, min_pages=5, copies=False).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(d) and by[3].text == "own 3\n\nend" and (by[3].n_lines, by[3].n_dropped) == (4, 2) or by[3].text == "own 3\n"
    assert by[21].text == "Rare\nown 21" and by[90].text is None and by[91].text == "" and by[92].text == "Shared line" and by[93].text == "copied\npage"
    assert site_lines.dropped(empty).count() == 0
    assert site_lines.cleaned(spark.createDataFrame(rows(), SCHEMA)).columns == [c.split()[0] for c in SCHEMA.split(", ")]


# --- 4


def brute_counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def test_statistics_match_brute_force(spark, docs):
    for d in (docs, spark.read.parquet(f"{DATA}/documents.parquet")):
        got = rules_list.statistics(d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
        assert counted(tuple(r) for r in got) == counted((r.doc_id, *brute_counts(r.text)) for r in d.select("doc_id", "text").collect())


def test_decision_list_learns_and_explains(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.random((600, 3))
    low = (x[:, 0] > 0.8) | ((x[:, 1] < 0.2) & (x[:, 2] > 0.5))
    found = rules_list.learn(x, low, ["a", "b", "c"], rng.integers(0, 3, 600))
    said = np.zeros(600, dtype=bool)
    for rule in found:
        said |= rules_list._matches(x, ["a", "b", "c"], rule)
    assert (said == low).mean() > 0.97 and 2 <= len(found) <= 6


def test_rules_do_not_depend_on_the_order_of_rows(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = rules_list.fit(d, lab)
    assert rules == rules_list.fit(d.repartition(16), lab.orderBy("doc_id", ascending=False)) == rules_list.fit(d.orderBy("text").coalesce(1), lab.repartition(3))
    assert rules


def test_every_threshold_is_tried():
    import numpy as np

    x = np.arange(3000, dtype=float)[:, None]
    assert rules_list._grow(x, x[:, 0] >= 1234, ["a"], 4) == [("a", ">=", 1233.5)]


def test_rules_on_awkward_rows(docs, labels, empty):
    out = rules_list.judged(docs, labels)
    assert out.count() == len(rows()) and out.where("doc_id = 57 and kept").count() == 0
    assert rules_list.judged(empty, labels).count() == 0
    assert rules_list.judged(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_rules_tell_quality_of_texts_not_learnt_from(spark):
    from pyspark.sql import functions as F

    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    learnt = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rules = rules_list.fit(d, lab.where(learnt))
    out = rules_list.statistics(d.join(lab.where(~learnt), "doc_id", "left_semi")).where(~F.expr(rules_list.BASE_FAILED)).withColumn("kept", rules_list.expression(rules)).join(lab, "doc_id").toPandas()
    low = out.quality == 0
    assert low.sum() > 100 and (~out.kept[low]).mean() > 0.9 and out.kept[~low].mean() > 0.98


def test_rules_tell_quality(spark):
    out = rules_list.judged(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").toPandas()
    out = out[~out.base_failed]
    assert ((out.quality == 1) == out.kept).mean() > 0.9


# --- 5


def test_decontamination_on_awkward_rows(spark, docs, empty):
    rng = random.Random(5)
    passage = text(rng, 30)
    bench = [(1, passage), (2, None), (3, ""), (4, "b"), (5, "a b"), (None, text(rng, 14)), (6, passage), (7, text(rng, 5))]
    extra = [(500, f"{text(rng, 10)} {passage.upper()} {text(rng, 10)}", "en", "s", 1, True, "x", 0.1), (501, bench[7][1], "en", "s", 1, True, "x", 0.1)]
    d = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = decontamination.judged(d, items).drop("text_key").collect()

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    windows = {}
    for i, t in bench:
        w = words(t)
        for k in range(max(1, len(w) - 12)) if w else []:
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = []
    for r in d.collect():
        w, hit, items_hit = words(r.text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    items_hit |= windows[tuple(w[k : k + n])]
        ids = sorted(str(i) for i in items_hit if i is not None)
        want.append((r.doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    assert counted(tuple(r) for r in got) == counted(want) and sum(w[2] > 0 for w in want) > 2
    assert decontamination.judged(empty, items).count() == 0
    assert decontamination.clean(d, items).count() == sum(not w[5] for w in want)
    assert decontamination.clean(d, items.limit(0)).columns == d.columns


def test_decontamination_beyond_the_broadcast_bound(spark, docs, monkeypatch):
    d, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    want = counted(decontamination.judged(d, items).collect())
    monkeypatch.setattr(decontamination, "BROADCAST_ANCHORS", 0)
    assert counted(decontamination.judged(d, items).collect()) == want


# --- 6


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def test_pseudonyms_keep_format_validity_and_links(spark):
    rng = random.Random(2)
    cards = []
    while len(cards) < 60:
        c = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        if luhn(c):
            cards.append(c)
    grouped = [" ".join(c[i : i + 4] for i in range(0, 16, 4)) for c in cards[:10]]
    other = ["+1 (269) 555-3296", "078-05-1120", "2024-02-29", "12/31/1999", "31.12.1999", "70.123.182.155", "some.one42@mail6.example.com"]
    bad = ["4111111111111112", "000-12-3456", "2023-02-29", "300.1.1.1", "999", "Version 2.0."]
    texts = [f"see {v} and {v}." for v in cards + grouped + other + bad] + [None, "", "nothing here", f"{cards[0]} {other[0]} {cards[1]}"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in pseudonyms.pseudonymised(d, "k").collect()}
    new = {}
    for i, v in enumerate(cards + grouped + other):
        a, b = re.fullmatch(r"see (.*) and (.*)\.", out[i].text).groups()
        shape = (lambda x: re.sub(r"\d+", "9", x)) if v == "70.123.182.155" else (lambda x: re.sub(r"\d", "9", re.sub("[a-z](?=.*@)", "a", x)))
        assert a == b != v and shape(a) == shape(v)
        assert out[i].n_replaced == 2
        new[v] = a
    assert len({new[c] for c in cards}) == len(cards) and all(luhn(new[c]) for c in cards)
    assert new[grouped[0]].replace(" ", "") == new[cards[0]]
    for i in range(len(bad)):
        assert out[len(cards) + len(grouped) + len(other) + i].text == texts[len(cards) + len(grouped) + len(other) + i]
    n = len(texts)
    assert out[n - 4].text is None and out[n - 3].text == "" and out[n - 2].text == "nothing here"
    assert out[n - 1].text == f"{new[cards[0]]} {new[other[0]]} {new[cards[1]]}"
    assert [r.text for r in pseudonyms.pseudonymised(d, "other key").limit(1).collect()] != [out[0].text]


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    d = spark.range(35 * 9)
    p = pseudonyms.feistel("k", "t", F.floor(F.col("id") / 9), F.col("id") % 9, 35, 9)
    out = d.select((p["l"] * 9 + p["r"]).alias("x")).distinct().agg(F.count("*"), F.min("x"), F.max("x")).first()
    assert tuple(out) == (315, 0, 314)
    key, left, right = "k", 3, 4  # the same rounds in plain Python
    for i in range(pseudonyms.ROUNDS):
        f = lambda x, i=i: int(hashlib.sha256(f"{key}|t|{i}|{x}".encode()).hexdigest()[:15], 16)
        left, right = ((left + f(right)) % 35, right) if i % 2 == 0 else (left, (right + f(left)) % 9)
    assert d.where("id = 31").select(p.alias("p")).first().p == (left, right)


# --- 7


def brute_components(source, percent):
    sets = []
    for _, t in source:
        w = spaced(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    group = list(range(len(sets)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and 100 * k >= percent * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    least = {}
    for i, (ident, _) in enumerate(source):
        if ident is not None:
            least[find(i)] = min(ident, least.get(find(i), ident))
    return [(ident, len(sets[i]), least.get(find(i), ident) if sets[i] else ident) for i, (ident, _) in enumerate(source)]


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates_match_brute_force(spark, docs, block):
    got = near_duplicates.linked(docs, 85, block).collect()
    want = brute_components([(r[0], r[1]) for r in rows()], 85)
    assert counted((r.doc_id, r.n_shingles, r.component_id) for r in got) == counted(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("block", [1024, 2])
def test_near_duplicates_on_the_given_table(spark, block):
    """Blocks of two rows: nodes meet by the keys of the tables, and all groups are large."""
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    got = near_duplicates.linked(d, 85, block).collect()
    assert counted((r.doc_id, r.n_shingles, r.component_id) for r in got) == counted(brute_components([(r.doc_id, r.text) for r in d.collect()], 85))


def test_blocks_are_bounded_by_weight(spark):
    """A group whose rows are too heavy for one task is linked like a light one."""
    from provlake.llm import components

    rng = random.Random(4)
    sets = []
    for _ in range(8):
        base = rng.sample(range(10_000), 40)
        sets += [sorted(set(base[: 40 - k] + rng.sample(range(10_000, 20_000), k))) for k in range(5)]
    data = [(1, i, 1, len(s), s) for i, s in enumerate(sets)]
    d = spark.createDataFrame(data, "grp long, node long, copies long, n long, shingles array<long>")
    test = near_duplicates.SameSets(80)
    edges = [components.connect(d, ["shingles"], test, "n", most=most) for most in (components.MOST, 150)]
    one, two = ({(r.node, r.component) for r in components.components(e).collect()} for e in edges)
    assert one == two and len({c for _, c in one}) == 8


@pytest.mark.parametrize("hub", [256, 3])
def test_components_match_brute_force(spark, monkeypatch, hub):
    """Chains, stars and repeated edges; with a low bound nearly every node is a hub."""
    from provlake.llm import components

    monkeypatch.setattr(components, "HUB", hub)
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(30)] + [(500, 501 + i) for i in range(40)] + [(2000 - i, 900) for i in range(40)] + [(7, 7), (501, 500)]
    edges += [(rng.randrange(3000, 3300), rng.randrange(3000, 3300)) for _ in range(150)]
    group = {}
    find = lambda i: i if group.setdefault(i, i) == i else find(group[i])
    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            group[b] = a
    got = components.components(spark.createDataFrame(edges, components.EDGES)).collect()
    assert sorted(map(tuple, got)) == sorted((i, find(i)) for i in group)
    assert components.components(spark.createDataFrame([], components.EDGES)).count() == 0


def test_unique_documents_leave_one_of_each(docs, empty):
    out = near_duplicates.unique_documents(docs, 80)
    assert out.columns == docs.columns
    kept = counted(r.doc_id for r in out.collect())
    want = {i for i, n, c in brute_components([(r[0], r[1]) for r in rows()], 80) if i == c}
    assert {k for k in kept if k != "None"} == {str(i) for i in want if i is not None}
    assert all(kept[str(i)] == 1 for i in want if i is not None)
    assert near_duplicates.unique_documents(empty, 80).count() == 0 == near_duplicates.linked(empty, 85).count()


def test_collections_reach_the_miss_rate():
    n = near_duplicates.collections_for(85)
    p = 0.85**near_duplicates.HASHES
    assert n == 16 and (1 - p) ** n + n * p * (1 - p) ** (n - 1) <= near_duplicates.MISS


# --- 8


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    source = [(r.doc_id, r.text) for r in docs.collect()]
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in source}
    out = packing.pack(docs, queries.vocabulary(), 64, buffer_sequences=8).toPandas()
    assert out.length.sum() == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in source)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 64
    for x in out.itertuples():
        if x.doc_id == x.doc_id and x.doc_id not in (2,):
            want = ids[int(x.doc_id)]
            assert x.doc_tokens == len(want)
            assert x.ids_crc32 == zlib.crc32(b"".join(v.to_bytes(4, "little") for v in want[x.start : x.start + x.length]))
    for i, g in out[out.doc_id != 2].groupby("doc_id"):
        g = g.sort_values("start")
        assert list(g.start) == [0, *g.length.cumsum()[:-1]] and g.length.sum() == len(ids[int(i)])
    padded = out.sequence_id.nunique() * 64 - out.length.sum()
    assert padded < 64 * 3 * 2 and packing.pack(empty, queries.vocabulary()).count() == 0


def test_dealing_balances_cost():
    import numpy as np

    dealt = packing.deal(np.array([60, 50, 40, 30, 20, 10, 10]), 100, 1.0, 0.01)
    assert sum(x[2] for x in dealt) == 220 and max(x[3] for x in dealt) == 2


# --- 9


def test_rule_hosts_are_folded_as_url_hosts(spark):
    pages = spark.createDataFrame([(1, "http://x.\u00c4B.org/p"), (2, "http://org./p"), (3, "none"), (4, "http:///p")], "page_id long, url string")
    rules = spark.createDataFrame([("\u00c4b.ORG", "/", "block"), (None, "", "block")], "host string, path string, verdict string")
    assert {r.page_id: r.verdict for r in url_rules.judge(pages, rules).collect()} == {1: "block", 2: "allow", 3: "block", 4: "block"}


def test_url_rules_match_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    hosts = ["a.org", "b.a.org", "c.b.a.org", "ba.org", "org", "x.com", "com", "EX.com", "", "a.org:80"]
    paths = ["", "/", "/en", "/en/1", "/en/12?x=1", "/fr/#a", "/e", "/en/1/2"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + [None, "", "no scheme", "http://", "://a.org/en"]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in ["a.org", "b.a.org", "org", "com", "x.com"] for p in ["/", "/en", "/en/1", ""] if rng.random() < 0.7]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, rule string").repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")

    def judge(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[2:] if fit else (None, "allow")))

    want = counted((i, *judge(u)) for i, u in enumerate(urls))
    assert counted(tuple(r) for r in url_rules.judge(pages, table).collect()) == want
    assert counted(tuple(r) for r in url_rules.judge(pages, table, block_rules=3).collect()) == want
    assert url_rules.judge(pages, table.limit(0)).where("verdict = 'allow'").count() == len(urls)
    assert url_rules.judge(pages.limit(0), table).count() == 0


# --- 10


def test_toxicity_on_awkward_rows(docs, labels, empty):
    out = toxicity.judged(docs, labels)
    assert out.count() == len(rows()) and out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.judged(empty, labels).count() == 0
    assert toxicity.judged(docs, labels.limit(0)).where("score <> 0").count() == 0
    assert toxicity.without_toxic(docs, labels).columns == docs.columns


def test_toxicity_held_out(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    x = toxicity.judged(d, lab).join(lab, "doc_id").where("held_out").toPandas()
    said, true = x.predicted == 1, x.toxic == 1
    assert (said & true).sum() / max(1, said.sum()) > 0.85 and (said & true).sum() / true.sum() > 0.6


def test_toxicity_reads_no_label_of_the_held_out_fold(spark):
    from pyspark.sql import functions as F

    d, lab = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    held = toxicity.fold_of(F.col("doc_id")) == toxicity.HELD_OUT
    flipped = lab.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.fit(d, lab), toxicity.fit(d, flipped)
    assert (one.weights == two.weights).all() and one.bias == two.bias


def test_toxicity_risk_and_gradient_match_brute_force():
    """One step of the learner moves each weight against the sign of the numerical gradient of the risk's active part."""
    import numpy as np

    rng = np.random.default_rng(0)
    features, n_p, n_u, prior = 5, 12, 40, 0.2
    xp, xu = (rng.random((n_p, features)) < 0.5).astype(float), (rng.random((n_u, features)) < 0.2).astype(float)
    start = np.array([1.0, 0.5, 0.8, 0.2, 0.4])
    rows = lambda x: (*np.nonzero(x), len(x))
    w0 = np.append(start * 10 / (xp @ start).mean(), -2.0)
    loss = lambda z: 1 / (1 + np.exp(z))

    def parts(w):
        zp, zu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
        return prior * loss(zp).mean(), loss(-zu).mean() - prior * loss(-zp).mean()

    def active(w):
        one, other = parts(w)
        return one + other if parts(w0)[1] >= 0 else -other

    numeric = np.array([(active(w0 + e) - active(w0 - e)) / 2e-5 for e in np.eye(features + 1) * 1e-5])
    w, bias = toxicity.train(*rows(xp), *rows(xu), start, prior, steps=1, decay=0.0)
    moved = np.append(w, bias) - w0
    assert np.allclose(moved, -0.05 * np.sign(numeric), atol=2e-3)


def test_toxicity_scores_match_brute_force(spark):
    """Scores are the logistic sum of the weights of the distinct features of a text, however it is cut into segments."""
    import numpy as np
    import pyarrow as pa

    d, lab = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(d, lab)
    assert (model.weights > 0).any()
    texts = [r.text for r in d.limit(40).collect()] + [None, ""]
    texts.append(" ".join(t for t in texts if t))
    got = toxicity.scores(pa.array(texts), model)
    every = np.ones(toxicity.BUCKETS, dtype=bool)
    for t, s in zip(texts, got, strict=True):
        _, bucket = toxicity.present(pa.array([t], pa.string()), every)
        assert len(bucket) == len(set(bucket.tolist()))
        assert s == pytest.approx(1 / (1 + math.exp(-(float(model.weights[bucket].astype(float).sum()) + model.bias))), abs=1e-9)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_toxicity_learns_from_few_examples(spark, sf):
    d, lab = (spark.read.parquet(f"/root/testdata/{sf}/{n}.parquet") for n in ("documents", "labels"))
    x = toxicity.judged(d, lab).join(lab, "doc_id").toPandas()
    assert (x.predicted[(x.toxic == 1) & x.held_out]).sum() >= 2 and x.predicted[x.toxic == 0].sum() <= 1


# --- all


def test_fingerprints_do_not_depend_on_segments(monkeypatch):
    import pyarrow as pa

    from provlake.llm import _text

    texts = pa.array(["One two  three", "x" * 300 + " y", None, "", "é ß one TWO", "z" * 1000])
    whole = _text.Tokens(texts)
    spans = list(zip(*_text.windows(whole.raw, whole.offsets, 5), strict=True))
    monkeypatch.setattr(_text, "SEGMENT", 64)
    small = _text.Tokens(texts)
    assert (whole.h == small.h).all() and (whole.n == [3, 2, 0, 0, 4, 1]).all() and whole.h[0] == whole.h[7] and whole.h[1] == whole.h[8]
    rows, prints = ([x for part in _text.windows(small.raw, small.offsets, 5) for x in part[k].tolist()] for k in (0, 1))
    assert rows == [x for p in spans[0] for x in p.tolist()] and prints == [x for p in spans[1] for x in p.tolist()]


def test_long_texts_take_bounded_memory():
    """Some bytes for each byte of one long text, in what a worker holds."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from provlake.llm import _text

    long = pa.array([" ".join(f"word{i % 5000}" for i in range(2_000_000))])
    wanted = np.zeros(toxicity.BUCKETS, dtype=bool)
    wanted[::50] = True
    for run, most in ((lambda: _text.Tokens(long), 16), (lambda: toxicity.present(long, wanted), 24)):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most * long.nbytes


TAKEN = "row text_key found made host lines page key passages gone all id place score n_replaced __host __lines __all __kept __id __key __found __made __text __score __n _n_replaced".split()


def test_extra_columns_with_clashing_names(spark, labels):
    """Columns with names that operators use themselves stay as they are, or are ignored."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows()[-14:], SCHEMA)
    d = d.withColumns({n: F.lit("mine") for n in TAKEN})
    items = spark.createDataFrame([(1, "the of big up"), (2, None)], "item_id long, text string")
    kept = [site_lines.cleaned(d), site_lines.cleaned(d, **site_lines.HOST_RULE), decontamination.clean(d, items), toxicity.without_toxic(d, labels), near_duplicates.unique_documents(d, 80)]
    for out in kept:
        assert out.columns == d.columns and {r.place for r in out.collect()} == {"mine"}
    out = pseudonyms.pseudonymised(d, "k")
    assert out.columns == [*d.columns, "__n_replaced"] and out.where("n_replaced = 'mine'").count() == d.count()
    for out in (importance.resample(d, labels.where("quality = 1")), interpolation.scored(d), site_lines.dropped(d), rules_list.judged(d, labels), decontamination.judged(d, items), near_duplicates.linked(d), packing.pack(d, queries.vocabulary()), toxicity.judged(d, labels)):
        assert out.count() >= d.count()


def test_pseudonyms_on_awkward_rows(spark, docs, empty):
    """Nulls, blanks, repeated rows, a null id and a very long text: each row stays, texts without values as they are."""
    long = "call +1 (269) 555-3296 now " * 4000
    d = docs.unionByName(spark.createDataFrame([(900, long, "en", "s", 1, True, "x", 0.1)], SCHEMA))
    out = pseudonyms.pseudonymised(d, "k")
    got, want = counted((r.doc_id, r.text) for r in out.where("doc_id is null or doc_id <> 900").collect()), counted((r.doc_id, r.text) for r in docs.collect())
    assert got == want and pseudonyms.pseudonymised(empty, "k").count() == 0
    one = out.where("doc_id = 900").first()
    assert one.n_replaced == 4000 and len(set(re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", one.text))) == 1 and len(one.text) == len(long)


def feistel_brute(key, kind, left, right, a, b):
    for i in range(pseudonyms.ROUNDS):
        f = lambda x, i=i: int(hashlib.sha256(f"{key}|{kind}|{i}|{x}".encode()).hexdigest()[:15], 16)
        left, right = ((left + f(right)) % a, right) if i % 2 == 0 else (left, (right + f(left)) % b)
    return left, right


def test_pseudonyms_match_brute_force(spark):
    """Cards, phones, addresses of hosts and dates, by the same rounds in plain Python."""
    import datetime

    values, want = [], []
    rng = random.Random(6)
    while len(values) < 20:
        c = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        if luhn(c):
            left, right = feistel_brute("k", "card", int(c[1:8]), int(c[8:15]), 10**7, 10**7)
            head = f"{c[0]}{left:07d}{right:07d}"
            values.append(c)
            want.append(next(head + x for x in "0123456789" if luhn(head + x)))
    for p in ("269-555-3296", "(415) 321-0000"):
        d = re.sub(r"\D", "", p)
        left, right = feistel_brute("k", "phone", int(d[1:3] + d[4:6]), int(d[6:]), 10_000, 10_000)
        new = iter(f"{d[0]}{left:04d}"[:3] + d[3] + f"{left:04d}"[2:] + f"{right:04d}")
        values.append(p)
        want.append(re.sub(r"\d", lambda _, new=new: next(new), p))
    for ip in ("70.123.182.155", "8.8.8.8"):
        a, b, c, d = map(int, ip.split("."))
        left, right = feistel_brute("k", "ip", a * 256 + b, c * 256 + d, 65_536, 65_536)
        values.append(ip)
        want.append(f"{left // 256}.{left % 256}.{right // 256}.{right % 256}")
    for day in ("2024-02-29", "1900-01-01", "2099-12-31"):
        k = (datetime.date.fromisoformat(day) - datetime.date(1900, 1, 1)).days
        left, right = feistel_brute("k", "date", k // pseudonyms.DATE_RIGHT, k % pseudonyms.DATE_RIGHT, pseudonyms.DATE_LEFT, pseudonyms.DATE_RIGHT)
        values.append(day)
        want.append(str(datetime.date(1900, 1, 1) + datetime.timedelta(left * pseudonyms.DATE_RIGHT + right)))
    d = spark.createDataFrame([(i, f"a {v} b") for i, v in enumerate(values)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pseudonyms.pseudonymised(d, "k").collect()}
    assert [got[i] for i in range(len(values))] == [f"a {w} b" for w in want]


def test_importance_weights_match_brute_force(spark, docs, labels, empty):
    """Weights are the log ratio of the two bags of buckets, recounted one text at a time."""
    import numpy as np
    import pyarrow as pa

    target = labels.where("quality = 1")
    wanted = {r.doc_id for r in target.collect()} - {None}  # a null id is no target
    raw, good, held = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS), []
    for r in docs.collect():
        _, bucket = importance.buckets(pa.array([r.text], pa.string()))
        held.append((r.doc_id, bucket))
        np.add.at(raw, bucket, 1)
        if r.doc_id in wanted:
            np.add.at(good, bucket, 1)
    ratio = np.log((good + 1) / (good.sum() + importance.BUCKETS)) - np.log((raw + 1) / (raw.sum() + importance.BUCKETS))
    got = counted((None if x.doc_id != x.doc_id else int(x.doc_id), round(x.log_weight, 6)) for x in importance.resample(docs, target).toPandas().itertuples())
    assert got == counted((i, round(float(ratio[b].sum()), 6)) for i, b in held)
    assert importance.resample(empty, target).count() == 0


def test_interpolation_notices_another_reading():
    """A chunk whose keys differ, though not in number, is an error."""
    import numpy as np
    import pyarrow as pa

    column = pa.array(["one two three"])
    _, now, before = interpolation.tokens_of([column])
    keys = interpolation.asked(now, before)[0]
    part = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([1]), column], names=["fold", "doc_id", "text"])
    right = {"shard": [0], "n": [len(keys)], "every": [interpolation.packed(np.ones(len(keys), dtype=np.int64))]}
    interpolation.counted([part], pa.table(right | {"proof": [interpolation.proof(keys)]}), "every")
    with pytest.raises(ValueError, match="another order"):
        interpolation.counted([part], pa.table(right | {"proof": [interpolation.proof(keys + np.uint64(2))]}), "every")


def test_one_host_with_very_many_rules(spark):
    """Rules of one host over several blocks, repeated rows and a very long url."""
    table = spark.createDataFrame([("a.org", f"/p{i}", "block") for i in range(500)] + [("a.org", "/", "allow")], "host string, path string, verdict string")
    urls = ["http://x.a.org/p499/z", "http://a.org/q", "http://a.org/p12" + "y" * 100_000, "http://a.org/q"]
    got = sorted((r.page_id, r.rule, r.verdict) for r in url_rules.judge(spark.createDataFrame([(min(i, 1), u) for i, u in enumerate(urls)], "page_id long, url string"), table, block_rules=60).collect())
    assert got == sorted([(0, "a.org/p499", "block"), (1, "a.org/", "allow"), (1, "a.org/p12", "block"), (1, "a.org/", "allow")])
