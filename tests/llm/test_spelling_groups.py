import random
import re
import zlib
from collections import Counter

from wareloom.llm import spelling_groups
from wareloom.llm.spelling_groups import grouped


def brute_force(docs, damage=199, least_length=6, least_count=5):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= least_length and c >= least_count}
    letters = sorted({c for w in n for c in w})
    form, near = {}, {}
    for w in n:
        others = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        others = (others & set(n)) - {w}
        best = min(others, key=lambda x: (-n[x], x), default=None)
        near[w], form[w] = len(others), best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], near[w], n.get(form[w])))
    return out


def test_equals_brute_force(spark):
    """Few letters and many runs of equal ones; a common word in every text; accented capitals stay as they are."""
    rng = random.Random(8)
    words = ["".join(rng.choice("aabÀé") for _ in range(rng.randint(4, 9))) for _ in range(250)]
    words += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "baaaaaa", "aaaaaab"]
    docs = [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, range(1, len(words) + 1), k=60)) + " letters " * rng.choice([1, 9])) for i in range(120)]
    rows = grouped(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), damage=7).collect()
    assert len(rows) == len({r.word for r in rows})
    want = brute_force(docs, damage=7)
    assert {tuple(r) for r in rows} == want
    assert any(w[1] for w in want) and any(w[4] > 3 for w in want)


def test_chains_go_to_the_last_form(spark):
    text = " ".join(w + " " for w, n in (("abcdefgh", 3125), ("abcdefg", 625), ("abcdef", 125), ("abcdxf", 25), ("abydxf", 5)) for _ in range(n))
    rows = {r.word: r for r in grouped(spark.createDataFrame([(1, text)], "doc_id long, text string"), damage=1 << 40).collect()}
    assert {r.root for r in rows.values()} == {"abcdefgh"} and rows["abydxf"].form == "abcdxf" and rows["abcdefgh"].form is None


def test_a_range_holds_one_word_per_letter(spark):
    words = spark.createDataFrame([(w, 5) for w in {a + b + "cdef" for a in "abcdefghij" for b in "abcdefghij"}], "word string, n long")
    assert spelling_groups.rotations(words).groupBy("prefix").count().agg({"count": "max"}).first()[0] == 10


def test_odd_rows(odd_docs, odd_rows, no_docs):
    assert {tuple(r) for r in grouped(odd_docs, least_length=3).collect()} == brute_force([r[:2] for r in odd_rows], least_length=3)
    assert grouped(no_docs).collect() == []
