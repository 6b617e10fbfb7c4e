import random
from collections import Counter

import pytest

from wareloom.llm import license_scan

MIT = license_scan.TEMPLATES["MIT permission"][0]


def words_of(text):
    return [w for w in license_scan.plain_words(text or "") if w]


def shingles(words):
    return [" ".join(words[i : i + 5]) for i in range(len(words) - 4)]


def brute(text):
    found = {}
    held = shingles(words_of(text))
    for name, (notice,) in license_scan.TEMPLATES.items():
        wanted = set(shingles(words_of(notice)))
        step = -(-len(wanted) // 4)
        best = max((len(wanted & set(held[k : k + len(wanted) + step])) / len(wanted) for k in range(0, len(held), step)), default=0)
        if best >= 0.8:
            found[name] = round(best, 9)
    return found


def test_equals_a_search_of_all_windows(spark):
    rng = random.Random(7)
    filler = lambda: " ".join(rng.choice(["alpha", "beta", "licensed", "under", "the", "license"]) for _ in range(rng.randint(0, 70)))
    texts = [f"{filler()}\n{notice.upper() if rng.random() < 0.3 else notice} {filler()}" for (notice,) in license_scan.TEMPLATES.values() for _ in range(3)]
    texts += [MIT.replace("charge", "cost"), MIT.replace("charge", "cost").replace("copy", "file"), "Released under the MIT license", "Released under a MIT License", filler(), None, "", "one two"]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, {})[r.license] = round(r.containment, 9)
    assert got == {i: brute(t) for i, t in enumerate(texts) if brute(t)}


def test_rows_are_kept_apart(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "x " * 5000 + "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    assert Counter((r.doc_id, r.license) for r in license_scan.scan(docs).collect()) == {(1, "MIT"): 2, (None, "CC-BY-NC-4.0"): 1}
    assert license_scan.scan(odd_docs).collect() == [] and license_scan.scan(no_docs).collect() == []


def test_short_templates_are_refused(spark):
    with pytest.raises(ValueError):
        license_scan.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), {"x": ("too short",)})


def test_bank_names_other_wordings_bodies_and_versions(spark):
    from wareloom.llm import license_bank

    texts = license_bank.bank()
    family = {n.split("|")[0]: license_bank.family(n.split("|")[0]) for n in texts}
    with open(license_bank._FOLDER + "/GPL-2.txt") as lines:
        body = lines.read()
    notices = ["This work is licensed under the GNU General Public License, version 2", "Licensed under the MIT License", "Licensed under the ISC License.",
               "This work is licensed under the GNU General Public License, version 3.", license_bank._TEXTS["BSD-3-Clause"][0].replace("the copyright holder nor", "Example Inc nor"), body]
    docs = spark.createDataFrame(list(enumerate(notices)), "doc_id long, text string")
    got = {}
    for r in license_scan.named(docs, texts, family).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert [got.get(i, set()) - {"BSD", "GPL header"} for i in range(5)] == [{"GPL-2.0"}, {"MIT"}, {"ISC"}, {"GPL-3.0"}, {"BSD-3-Clause"}]
    assert "GPL-2.0" in got[5] and "GPL-3.0" not in got[5]
