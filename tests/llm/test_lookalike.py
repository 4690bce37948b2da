import unicodedata as ud

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hubloom.llm import lookalike as L

LATIN = "ABCEHIKMOPSTXYaceijopsxy"
CYRILLIC = "АВСЕНІКМОРЅТХУасеіјорѕху"


@pytest.fixture(scope="module")
def looks(spark):
    return L.Looks.of(spark)


@pytest.mark.parametrize(
    "a, b",
    [
        ("nœud", "nœuԁ"), ("BRT 12", "ВRТ 12"), ("café", "café"), ("café", "cаfе́"), ("full １２", "full 12"), ("ab", "a​b"), ("a b", "a b"), ("a b", "a　b"),
        ("ﬁeld", "field"), ("ⅿetro", "metro"), ("שׁלום", "שׁלום"), ("הלו", "ﬣלו"), ("вода", "вoдa"), ("a͏́", "á"), ("й", "й"), ("x\r\ny", "x\ny"), ("Ｂus", "Вus"), ("ё", "ë"),
    ],
)
def test_same_look(a, b, looks):
    assert L.canonical_text(a, {}, looks) == L.canonical_text(b, {}, looks)
    assert L.canonical_text(a, {"c": "с"}, looks) == L.canonical_text(b, {"c": "с"}, looks)


@pytest.mark.parametrize(
    "a, b",
    [("m²", "m2"), ("①", "1"), ("a", "A"), ("cafe", "café"), ("a-b", "a–b"), ("it's", "it’s"), ("תחנה", "תַּחֲנָה"), ("м²", "m²"), ("a b", "a  b"), ("a b", "a\nb"), ("שׁ", "ש"), ("к", "k"), ("a.", "a!"), ("ו", "ן"), ("O", "0"), ("l", "I"), ("l", "1"), ("Ь", "b"), ('"', "״")],
)
def test_different_look(a, b, looks):
    assert L.canonical_text(a, {}, looks) != L.canonical_text(b, {}, looks)


def test_spelled_by_its_script(looks):
    assert L.canonical_text("вoдa", {}, looks) == "вода" and L.canonical_text("stаtiоn", {}, looks) == "station"


@given(t=st.text(alphabet=CYRILLIC + LATIN + "дшflя 12é́​", max_size=20))
@settings(suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_canonical_is_stable_and_keeps_the_look(looks, t):
    chosen = {"c": "с", "Bce": "Все"}
    once = L.canonical_text(t, chosen, looks)
    assert L.canonical_text(once, chosen, looks) == once
    assert looks.look(L.folded(once)) == looks.look(L.folded(t))


def brute_distance(query, word, looks, edit):
    """Weighted edit distance by dynamic programming."""
    d = [edit * k for k in range(len(word) + 1)]
    for ch in query:
        skip = 0.0 if L._FOLDS[ord(ch)] == "" else edit
        new = [d[0] + skip]
        for j, w in enumerate(word, 1):
            change = 0.0 if looks.look(ch) == looks.look(w) else L.HALF if looks.skeleton(ch) == looks.skeleton(w) else edit
            new.append(min(d[j] + skip, new[j - 1] + edit, d[j - 1] + change))
        d = new
    return d[-1]


@given(query=st.text(alphabet="acсеeдBꓐ​", max_size=6), words=st.sets(st.text(alphabet="acсеeдBꓐ", min_size=1, max_size=5), min_size=1, max_size=6), budget=st.sampled_from([0.0, 1.0, 2.0]), edit=st.sampled_from([1.0, 2.0]))
@settings(suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_trie_matches_brute_force(looks, query, words, budget, edit):
    got = {w: c for c, w, _ in L.Trie({w: 1 for w in words}, looks).matches(query, budget, edit)}
    want = {w: d for w in words if (d := brute_distance(query, w, looks, edit)) <= budget}
    assert got == want


def test_very_long_words(looks):
    long = "ab" * 50_000
    assert L.Trie({long: 1}, looks).matches(long.replace("a", "а", 3) + "\u200b", 1.0) == [(0.0, long, 1)]


DOCS = "doc_id long, text string, look_hash string, key string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("limit", [L.BROADCAST_SPELLINGS, 0])
def test_pairs(spark, limit):
    texts = ["Все они", "Bce они", "Bce они", "все они", None, "", "​", "BC 5", "ВС 5", "ВС 5", "ВС ВС", "x" * 100_000 + "о", "x" * 100_000 + "o"]
    forms = L.canonicalize(docs(spark, texts), max_broadcast=limit)
    by = {r.doc_id: r for r in forms.collect()}
    assert by[0].canonical == by[1].canonical == "Bce они" and by[7].canonical == by[8].canonical == "ВС 5"
    assert by[4].canonical is None and by[5].canonical == by[6].canonical == ""
    got = {(r.doc_a, r.doc_b) for r in L.look_pairs(forms).collect()}
    want = {
        (i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))
        if texts[i] is not None and texts[j] is not None and texts[i] != texts[j] and by[i].canonical == by[j].canonical
    }
    assert got == want == {(0, 1), (0, 2), (5, 6), (7, 8), (7, 9), (11, 12)}


def test_empty(spark):
    assert L.look_pairs(L.canonicalize(docs(spark, ["a"]).limit(0))).count() == 0


def spelled(spark, looks, texts, shards=None):
    words = L.corpus_words(docs(spark, texts), looks)
    return {r.look: r.spelling for r in L.spellings(words, looks, shards).collect()}


@pytest.mark.parametrize("shards", [None, 3])
def test_spelling_by_count(spark, looks, shards):
    assert spelled(spark, looks, ["Bce " * 3, "Все " * 9, "Bсe " * 20, "cop", "сор"], shards) == {"Bce": "Все"}


def test_the_trie_knows_what_the_table_does_not(spark, looks):
    texts = ["ꓐUS stop", "BUS stop", "ꓐUＳ stop", "ꓐUZ stop", "сtаtiⲟn stסp", "station stop"]
    by_table = [L.canonical_text(t, {}, looks) for t in texts]
    assert by_table[0] != by_table[1]
    forms = {r.doc_id: r.canonical for r in L.canonicalize(docs(spark, texts)).collect()}
    assert forms[0] == forms[1] == forms[2] == "BUS stop"
    assert forms[3] == "ꓐUZ stop"  # no such word: by table
    assert forms[4] != forms[5]  # c is not s, and one change is over the budget
    assert forms[4].split()[1] == "stop"


def test_ignorables_inside_words(spark, looks):
    words = {r.word: r for r in L.corpus_words(docs(spark, ["sta\u200btion station"]), looks).collect()}
    assert words["sta\u200btion"].asked and not words["sta\u200btion"].pure and words["station"].pure
    assert words["sta\u200btion"].key == words["station"].key


def test_classes(spark):
    forms = L.canonicalize(docs(spark, ["Bce", "Все", "Все", "x", "x", None, "", "\u200b"]))
    assert {(r.first_doc, r.n_docs, r.n_texts) for r in L.look_classes(forms).collect()} == {(0, 3, 2), (6, 2, 2)}


def test_folds_are_by_rule():
    assert L.folded("Ω") == ud.normalize("NFC", "Ω") and L.folded("²①") == "²①" and L.folded("ſ") == "ſ"
