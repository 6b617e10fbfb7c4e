import random
import re
from collections import Counter

from wareloom.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_measures_equal_plain_python(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 80))) for _ in range(40)] + ["x\x1cy z\x0b\n\n x\x1cy z\x0b\n#|<", "a b\r\na b\r\na b\n", "a " * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.judged(docs).collect():
        n_words, *_, n_repeat = want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n_words < 20 or 100 * n_repeat > 30 * n_words)
        assert not (r.kept and r.base_failed)
    got = quality_rules.judged(odd_docs).collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter((row[0], brute(row[1])[0]) for row in odd_rows)
    assert quality_rules.judged(no_docs).collect() == []


def test_rules_reject_junk_and_keep_prose(spark):
    prose = "The river runs to the north of the town, and in the spring it carries the light of the stones that lie under it, so that all who pass by the old mill see how slowly it goes."
    junk = [" ".join(w + "$$$" for w in prose.split()), prose.upper().replace(" ", "!! "), " | ".join(prose.split()), " ".join(w + " " + w for w in prose.split()[:7] for _ in range(3))]
    rows = quality_rules.judged(spark.createDataFrame(list(enumerate([prose, *junk])), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.kept for r in rows] == [True, False, False, False, False]


def test_a_table_without_rules_leaves_the_base(spark):
    row = quality_rules.judged(spark.createDataFrame([(1, "$ " * 7 + " ".join(map(str, range(20))))], "doc_id long, text string"), ()).first()
    assert row.kept and row.broken_rules == []
