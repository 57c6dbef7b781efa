import re

from gladeline.llm import licenses
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def plain(text):
    return " ".join(WORD.findall(text.translate(LOWER)))


RARE_FIRST = " ".join(sorted({w for t in licenses.NOTICES for w in WORD.findall(t.text.translate(LOWER))}))
TEXTS = ODD + [
    "MIT License mit, license MIT\nLICENSE general public license", "general public general public license", "mit", "license mit",
    "apache  license\x85version", "Apache-License 2.0 and MIT license " * 400, RARE_FIRST + " the mit license, GNU general public license",
    "public license general", "mit licenses",
]


def test_base_places_match_a_plain_scan(documents):
    docs = documents([(i, t, "en") for i, t in enumerate(TEXTS)]).repartition(3)
    rows = {r.doc_id: r for r in licenses.license_report(docs).collect()}
    assert [tuple(rows[i])[1:6] for i in range(len(TEXTS))] == [base(t) for t in TEXTS]
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows.values())


def test_places_do_not_cross_documents(documents):
    rows = licenses.license_report(documents([(1, "the mit", "en"), (2, "license text", "en")]).coalesce(1)).collect()
    assert [r.n_base for r in rows] == [0, 0]


def test_notices_are_found_whole_with_names_and_line_marks(documents):
    for notice in licenses.NOTICES:
        words = notice.text.split()
        # the first place from the middle on that is inside no key phrase
        cuts = (" ".join([*words[:m], "#", "2024", "Someone", *words[m:]]) for m in range(len(words) // 2, len(words) + 1))
        drifted = next(t for t in cuts if all(k in plain(t) for k in notice.keys or (notice.text,)))
        texts = [f"intro words {drifted} and more", " ".join(words[: max(1, len(words) // 3)])]
        rows = licenses.license_report(documents([(i, t, "en") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
        assert notice.label in rows[0].labels.split(","), notice
        assert rows[0].score > 0.6 and notice.label not in rows[1].labels.split(","), notice


def test_a_missing_key_phrase_rejects(documents):
    mit = licenses.NOTICES[0].text
    broken = mit.replace("without restriction", "with every restriction")
    rows = licenses.license_report(documents([(1, mit, "en"), (2, broken, "en")])).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["mit", ""] and [r.base_labels for r in rows] == ["", ""]


def test_places_rarity_and_empty_table(documents):
    docs = documents([(1, "x the mit license y", "en"), (None, "x", "en")])
    row = licenses.find_licenses(docs).filter("doc_id = 1").first()
    assert [p.asDict() for p in row.places] == [{"label": "mit", "base": True, "first": 2, "end": 4, "share": 1.0}]
    assert licenses.license_report(docs.limit(0)).count() == 0
    holding, n = licenses.count_holders(documents([(i, t, "en") for i, t in enumerate(["mit mit", "mit license", None])]))
    assert n == 3 and holding["mit"] == 2 and holding["license"] == 1 and holding["apache"] == 0


def test_other_templates_can_be_given(documents):
    own = (licenses.Template("house", "all rights reserved by nobody", base=True),)
    row = licenses.license_report(documents([(1, "so: All rights reserved, by Nobody.", "en")]), own).first()
    assert (row.n_base, row.first_word, row.labels, row.score) == (1, 1, "house", 1.0)
