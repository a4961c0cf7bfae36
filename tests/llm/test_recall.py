"""Near-duplicate recall on planted pairs close to the threshold, alone and within a large family."""

import random

from provlake.llm import near_duplicates

PAIRS, FAMILY = 3000, 3000


def jaccard(x: list[str], y: list[str]) -> float:
    a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (x, y))
    return len(a & b) / len(a | b)


def test_pairs_from_085_to_090(spark, capsys):
    """One word of 66 to 99 changed gives 0.85 to 0.90; a family is one text with each of its members changed in one place."""
    rng = random.Random(17)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]

    def changed(words):
        at = rng.randrange(5, len(words) - 5)
        return [*words[:at], f"x{rng.randrange(10**9)}", *words[at + 1 :]]

    docs, pairs, i = [], [], 0
    for _ in range(PAIRS):
        a = text(rng.randrange(66, 100))
        b = changed(a)
        assert 0.85 <= jaccard(a, b) < 0.91
        docs += [(i, " ".join(a)), (i + 1, " ".join(b))]
        pairs.append((i, i + 1))
        i += 2
    base, first = text(70), i
    docs.append((i, " ".join(base)))
    for _ in range(FAMILY):
        i += 1
        docs.append((i, " ".join(changed(base))))
    far = [(j, " ".join(t)) for j, t in enumerate((text(70) for _ in range(200)), i + 1)]
    rng.shuffle(docs)
    rows = spark.createDataFrame(docs + far, "doc_id long, text string").repartition(8)
    component = {r.doc_id: r.component_id for r in near_duplicates.linked(rows, 85).select("doc_id", "component_id").collect()}
    found = sum(component[a] == component[b] == a for a, b in pairs)
    family = sum(component[j] == first for j in range(first, first + FAMILY + 1))
    with capsys.disabled():
        print(f"\nplanted pairs found {found} of {PAIRS}, members of a family {family} of {FAMILY + 1}")
    assert found >= 0.99 * PAIRS and family >= 0.99 * (FAMILY + 1)
    assert all(component[j] == j for j, _ in far)
