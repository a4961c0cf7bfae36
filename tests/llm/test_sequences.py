"""Conversation tries, token files and collocations against brute force, and on awkward rows."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provlake.llm import collocations, packing, prefix_trie, queries, token_planes

DATA = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string, node string, depth long, block long"
DOCS = "doc_id long, text string, lang string, rank long, part int, n long, phrase string"


def conversations(seed):
    """Shared beginnings, copies, nulls, ties, repeats, one long conversation, and columns that clash."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(40), *range(100, 130), *range(205, 215), 401]:
        n = 150 if c == 7 else rng.choice([0, 1, 2, 3, 4, 5, 7])
        for k in range(n):
            rows.append((c, None if k == 0 and c % 9 == 0 else k, rng.choice(["user", "user", None]), rng.choice(["a", "bb", "", None, "ß€𝄞"]) if k else "hello"))
    rows += [(300 + i, 0, "user", "hello") for i in range(60)]  # a hot conversation
    rows += [rows[3], rows[3], (None, 0, "user", "x"), (2, 1, "user", "tie"), (2, 1, "system", "tie")]
    return [(*r, "x", 1, 2) for r in rows]


def ordered(rows):
    """The turns of each conversation in the order the operator states."""
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            by[c].append(((turn is not None, turn or 0, role, digest), (role, text)))
    return {c: [x for _, x in sorted(v)] for c, v in by.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return out


def trie(convs):
    """Node rows by the definition."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()
    )


def node_rows(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


@pytest.mark.parametrize("block_rows, block_turns", [(1 << 14, 1 << 16), (1, 1 << 16), (3, 1 << 16), (7, 5)])
def test_trie_by_blocks(spark, block_rows, block_turns):
    rows = conversations(block_rows)
    seqs = prefix_trie.sequences(spark.createDataFrame(rows, CONV).repartition(3))
    got = node_rows(prefix_trie.nodes(queries.grafted(seqs), block_rows, block_turns))
    assert got == trie(rebuilt(ordered(rows)))
    if block_rows == 3:
        assert node_rows(prefix_trie.nodes(seqs, block_rows, block_turns)) == trie(ordered(rows))


def test_trie_of_turnless_and_of_none(spark):
    empty = spark.createDataFrame([], CONV)
    assert prefix_trie.nodes(prefix_trie.sequences(empty)).collect() == []
    rows = [(c, 0, "user", "x", "", 0, 0) for c in (3, 5, 9, 12)]  # h turns replaced by none: some have no turn left
    got = node_rows(prefix_trie.nodes(queries.grafted(prefix_trie.sequences(spark.createDataFrame(rows, CONV))), 2))
    assert got == trie(rebuilt(ordered(rows)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=6), min_size=1, max_size=25), st.integers(1, 5))
def test_trie_intervals(seqs, width):
    """Parts of blocks of any size add up to the nodes of the whole."""
    digest = lambda x: hashlib.md5(str(x).encode()).digest()
    rows = sorted((b"".join(map(digest, s)), i, s) for i, s in enumerate(seqs))
    blocks = [rows[k : k + width] for k in range(0, len(rows), width)]
    sums, found = {}, []
    for j, b in enumerate(blocks):
        before = -1 if j == 0 else prefix_trie.common(b[0][0], blocks[j - 1][-1][0])
        after = -1 if j + 1 == len(blocks) else prefix_trie.common(b[-1][0], blocks[j + 1][0][0])
        out = prefix_trie.block_nodes(np.array([r[1] for r in b]), np.array([len(r[2]) for r in b]), b"".join(r[0] for r in b), np.array([x + 1 for r in b for x in r[2]], dtype=np.int64), before, after)
        for node, d, c, n, kids, leaves, saved in zip(*(list(out[k]) for k in ("node", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), strict=True):
            new = (int(c), int(d), int(n), int(kids), int(leaves), int(saved))
            if node is None:
                found.append(new)
            else:
                old = sums.get(node, (10**9, int(d), 0, 0, 0, 0))
                sums[node] = (min(old[0], new[0]), int(d), *(x + y for x, y in zip(old[2:], new[2:], strict=True)))
    want = [(r[0], r[1], *r[3:7]) for r in trie({i: [("", "x" * (x + 1)) for x in s] for i, s in enumerate(seqs)})]
    assert sorted(found + list(sums.values())) == sorted(want)


# --- token files

WORDS = ["the", "Of", "it's", "don't", "é", "ß1", "x,'s", "(a)", "1984", "…", "a b", "né ", "\x1c", "!\x1c", "　", "日本", "''s", "5%", "<|endoftext|>", " "]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.byte_vocabulary())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, token_planes.END_ID]


def documents(seed=3, n=80):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(WORDS) + rng.choice([" ", "  ", "\n", "\n\n", ", ", "", "\t"]) for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(n)]
    texts += [None, "", " ", "\n", " " * 30, "a" * 5000, "".join(rng.choice(WORDS) + " " for _ in range(9000))]
    rows = [(i, t, ("en", "de", None)[i % 3], 1, 2, 3, "x") for i, t in enumerate(texts)]
    return rows + [rows[2], rows[2], (None, "no id", None, None, None, None, None), (-5, "minus", "en", 0, 0, 0, "")]


def encoder():
    with open(queries.byte_vocabulary(), encoding="utf-8") as f:
        return token_planes.ByteEncoder(f.read())


@pytest.fixture(scope="module")
def shared_encoder():
    return encoder()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\r'.,!s ta1é \u0085 　\x1c\x1f﻿᠎’€"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=4))
def test_pieces_give_the_tokenizer_s_ids(shared_encoder, tokenizer, texts):
    got, at = shared_encoder.ids(pa.array(texts))
    assert [got[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [ids_of(tokenizer, t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=50), max_size=12), st.booleans(), st.integers(1, 64), st.data())
def test_planes_round_trip(lists, bits, chunk, data):
    out = io.BytesIO()
    w = token_planes.PlaneWriter(out, bits, chunk)
    for k, x in enumerate(lists):
        w.add(None if k == 2 else k - 1, np.array(x, dtype=np.uint32))
    assert w.close() == len(out.getvalue())
    f = token_planes.PlaneFile(out)
    flat = [x for v in lists for x in v]
    assert [(d, a, v.tolist()) for d, a, v in f.documents()] == [(None if k == 2 else k - 1, sum(map(len, lists[:k])), x) for k, x in enumerate(lists)]
    a = data.draw(st.integers(0, len(flat)))
    b = data.draw(st.integers(0, len(flat) + 3))
    assert f.ids(a, b).tolist() == flat[a:b]


def test_planes_are_stored_by_need():
    ids = np.arange(1000, dtype=np.uint32)
    planes = token_planes.to_planes(ids, False)
    assert [len(p) for p in planes] == [1000, 1000, 0, 0] and planes[0][:3] == b"\0\1\2"
    assert [bool(p) for p in token_planes.to_planes(ids, True)] == [k < 10 for k in range(32)]
    with pytest.raises(ValueError):
        token_planes.PlaneFile(io.BytesIO(b"x" * 100))


@pytest.mark.parametrize("bits, chunk, file_ids", [(False, 1 << 16, 1 << 26), (True, 100, 2000)])
def test_token_files(spark, tokenizer, tmp_path, bits, chunk, file_ids):
    rows = documents()
    token_planes.write(spark.createDataFrame(rows, DOCS).repartition(5), queries.byte_vocabulary(), f"{tmp_path}/t", bits, chunk, file_ids)
    got = token_planes.read(spark, f"{tmp_path}/t").orderBy("start").collect()
    want = sorted((-(10**9) if r[0] is None else r[0], ids_of(tokenizer, r[1])) for r in rows)
    assert [(-(10**9) if r["doc_id"] is None else r["doc_id"], np.frombuffer(r["ids"], dtype="<u4").tolist()) for r in got] == want
    flat = [x for _, v in want for x in v]
    assert [r["start"] for r in got] == [sum(len(v) for _, v in want[:k]) for k in range(len(want))]
    assert token_planes.ids(spark, f"{tmp_path}/t", 50, len(flat) - 70).tolist() == flat[50:-70]
    assert token_planes.ids(spark, f"{tmp_path}/t", len(flat), len(flat) + 5).tolist() == []


def test_token_files_of_no_rows(spark, tmp_path):
    token_planes.write(spark.createDataFrame([], DOCS), queries.byte_vocabulary(), f"{tmp_path}/t")
    assert token_planes.read(spark, f"{tmp_path}/t").collect() == [] and len(token_planes.ids(spark, f"{tmp_path}/t", 0, 9)) == 0


def test_token_query(spark, tokenizer):
    got = sorted(map(tuple, queries.op12_token_planes(spark, DATA).collect()))
    start, want = 0, []
    for r in sorted(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()):
        ids = np.array(ids_of(tokenizer, r["text"]), dtype="<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


# --- collocations


def collocated(rows, max_words, least, top):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    often = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = defaultdict(list)
    for (lang, p), a in often.items():
        if not any(g == lang and len(q) > len(p) and b >= a and inside(p, q) for (g, q), b in often.items()):
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return sorted((lang, i + 1, r[2].decode(), -r[1], r[3], r[4], r[5], -r[0]) for lang, v in out.items() for i, r in enumerate(sorted(v)[:top]))


def phrase_rows(seed):
    rng = random.Random(seed)
    words = ["new", "York", "city", "of", "the", "é", "a", "𝄞", "ﬁ", "x\x1cy"]
    texts = [" ".join(rng.choice(words) if rng.random() < 0.6 else "new york city hall of the" for _ in range(rng.choice([1, 4, 30]))) for _ in range(150)]
    texts = [re.sub(" ", lambda _: rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", " ; "]), t) for t in texts] + [None, "", "  ,.;", "a a a a a a a a", "the " * 3000 + "end"]
    rows = [(i, t, ("en", "de", None, "und")[i % 4], 1, 2, 3, "x") for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, texts[4], "en", None, None, None, None)]


@pytest.mark.parametrize("seed, max_words, least, top", [(1, 5, 3, 2000), (2, 5, 10, 7), (3, 3, 4, 50)])
def test_collocations(spark, seed, max_words, least, top):
    rows = phrase_rows(seed)
    got = collocations.mined(spark.createDataFrame(rows, DOCS).repartition(4), max_words, least, top)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == collocated(rows, max_words, least, top)


def test_collocations_of_few_rows(spark):
    assert collocations.mined(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations.mined(spark.createDataFrame([(1, "one two one two", "en", 0, 0, 0, "")], DOCS)).collect() == []


def test_stripe_totals_and_flushes(monkeypatch):
    """A table that is emptied often, and forgets its words, adds up to the same stripes."""
    monkeypatch.setattr(collocations, "WORDS", 12)
    table, whole, got, rng = collocations.Stripes(2), Counter(), Counter(), random.Random(5)

    def emptied():
        for batch in table.rows():
            for r in batch.to_pylist():
                for lang, prefix, words, counts in zip(r["langs"], r["prefixes"], r["words"], r["counts"], strict=True):
                    for w, c in zip(words.split(" "), counts.split(" "), strict=True):
                        assert r["bucket"] == (int(w) % 2 if w else 0)
                        got[lang, prefix, w] += int(c)

    for _ in range(9):
        pairs = [(rng.randrange(1, 5), rng.randrange(8)) for _ in range(60)]
        words = np.array(pairs, dtype=np.uint64)
        whole.update(("l", str(a), str(b) if b else "") for a, b in pairs)
        table.add(words[:, 0] * np.uint64(100) + words[:, 1], lambda i, words=words: (["l"] * len(i), words[i], lambda r, c: str(int(words[i[r], c])), words[i, 0], words[i, 1] % np.uint64(2)))
        if rng.random() < 0.5:
            emptied()
    emptied()
    assert got == whole


def test_scores_beyond_64_bits(spark):
    """The products of the score are exact in the type the operator takes."""
    from pyspark.sql import functions as F

    a, n, low, r = 987_654_321_987, 123_456_789_123_457, 999_999_999_989, 987_654_321_991
    wide = spark.createDataFrame([(a, n, low, r)], "a long, n long, l long, r long").select(*(F.col(c).cast("decimal(38,0)").alias(c) for c in "anlr"))
    got = wide.select((F.lit(1000).cast("decimal(38,0)") * F.col("a") * F.col("n")).alias("up"), (F.col("l") * F.col("r")).alias("low")).select(F.expr("up div low").alias("s")).first()["s"]
    assert got == 1000 * a * n // (low * r)


def test_encoders_stay_apart():
    """The encoder of operator 8 and that of the token files keep their own pieces and end ids."""
    assert token_planes.ByteEncoder.kept is not packing.Encoder.kept and encoder().ids(pa.array([""]))[0].tolist() == [0]
