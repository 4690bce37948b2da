"""One form for texts that look alike but differ in their characters.

What a text looks like is fixed by a table: invisible characters count nothing, blanks of
every kind are one blank, full-width, wide and ligature forms are the letters they show,
and letters of different scripts that look alike are one look. The table is made by rule
from Unicode's own data: categories and decompositions, and the public list of confusable
characters (`Looks.of`). Accents are brought to one way of composing. Case, accents, vowel
points, raised and circled digits and punctuation keep their look.

The spelling is then chosen word by word. The corpus's own words of one script form a
vocabulary with counts. Words of mixed scripts or with disguised characters, and words all
of whose letters another script has too (``ВС`` or ``BC``), are sought in tries of that
vocabulary by a weighted edit automaton: a look-alike and an ignorable character cost
nothing, a letter that the public list holds for confusable though the table doesn't (of
scripts without case, such as ``ꓐ``, or of the other case) half, anything else more than
the budget. The cheapest match, of equal ones the most frequent, is canonical. A word
without a match is normalised by the table: to the script its unmistakable letters belong
to, else to Latin.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata as ud
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubloom.session import drop_written, written

#: Blanks besides those of category Zs, and characters without a look besides those of category Cf.
BLANKS = "\t\x0b\x0c\x1c\x1d\x1e\x1f\u2800"
IGNORABLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u180f\u3164\uffa0"
#: Kinds of compatibility form that look like what they stand for; of <compat> only letters.
FORMS = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
LONG_S = "\u017f\ufb05"
#: Letters that look like a Latin letter in most typefaces and that the public list of confusables leaves out or holds for another.
BESIDES = {"Ԛ": "Q", "ӏ": "l"}
#: What a letter costs that is confusable but not of the table, any other change, and how much may be spent on a word.
HALF, EDIT, BUDGET = 0.5, 2.0, 1.0
#: Words of one trie, on average.
SHARD = 50_000
_MARKS = "\u0300-\u036f\u0483-\u0487\u0591-\u05bd\u05bf\u05c1\u05c2\u05c4\u05c5\u05c7"
_UNSEEN = "\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\u00ad\u061c\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\U000e0100-\U000e01ef" + IGNORABLE
WORD = re.compile(rf"[\w{_MARKS}]+")
RAW_WORD = re.compile(rf"[\w{_MARKS}{_UNSEEN}]+")


def _fold_one(ch: str) -> str | None:
    """What a character outside ASCII shows; None if it shows itself."""
    kind = ud.category(ch)
    if kind == "Cf" or ch in IGNORABLE or "\ufe00" <= ch <= "\ufe0f" or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    if kind == "Zs" or ch in BLANKS:
        return " "
    if kind in ("Zl", "Zp") or ch == "\x85":
        return "\n"
    if kind == "Cc":
        return None if ch == "\n" else ""
    form = ud.decomposition(ch).partition(" ")[0]
    if form in FORMS or form == "<font>" and "\ufb20" <= ch <= "\ufb29":
        return ud.normalize("NFKC", ch)
    if form == "<compat>" and ch not in LONG_S:
        shown = ud.normalize("NFKC", ch)
        if all(ud.category(c)[0] == "L" for c in shown):
            return shown
    return None


class _Folds(dict):
    """The table by rule, filled as characters come up."""

    def __missing__(self, code: int) -> str | int:
        found = _fold_one(chr(code)) if code > 126 or code < 32 else None
        self[code] = code if found is None else found
        return self[code]


_FOLDS = _Folds()


def folded(text: str) -> str:
    """The text without differences that no letter's script is concerned in."""
    if text.isascii() and text.isprintable():
        return text
    return ud.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n").translate(_FOLDS))


class Looks:
    """The table of look-alikes, and what follows from it for words.

    confusable: character -> what the public list of confusables shows it as (its skeleton).
    """

    def __init__(self, confusable: dict[str, str]):
        self.confusable = confusable
        latin: dict[str, list[str]] = {}
        for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
            latin.setdefault(confusable.get(c, c), []).append(c)
        #: letter -> the Latin letter of its case that it looks like; only of scripts with case, whose letters stay apart among themselves
        self.shown = dict(BESIDES)
        for c, skeleton in confusable.items():
            case = ud.category(c)
            same = [x for x in latin.get(skeleton, ()) if ud.category(x) == case]
            if case in ("Lu", "Ll") and same and not c.isascii() and c not in BESIDES:
                self.shown[c] = same[0]
        self.table = {ord(c): x for c, x in self.shown.items()}
        #: script -> Latin letter -> the letter of the script that looks like it, the commonest first
        self.back: dict[str, dict[str, str]] = {}
        for c in sorted(self.shown, key=lambda c: (not "\u0391" <= c <= "\u044f", c)):
            self.back.setdefault(script(c), {}).setdefault(self.shown[c], c)
        self.back.pop("LATIN", None)
        self._forms: dict[str, tuple[str, str]] = {}

    @classmethod
    def of(cls, spark: SparkSession) -> Looks:
        """By the list of confusables that the ICU library beside Spark ships."""
        letters = [chr(c) for c in range(0x41, 0x20000) if not 0xD800 <= c < 0xE000 and ud.category(chr(c))[0] == "L"]
        checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        shown = checker.getSkeleton("\n".join(letters)).split("\n")
        if len(shown) != len(letters):
            raise RuntimeError("the list of confusables has another form than expected")
        return cls({c: s for c, s in zip(letters, shown) if s != c})

    def look(self, word: str) -> str:
        """The look of a folded word: every look-alike as its Latin letter."""
        return word if word.isascii() else ud.normalize("NFC", ud.normalize("NFD", word).translate(self.table))

    def skeleton(self, look: str) -> str:
        """What all words that any letters of the public list turn into one another have in common."""
        return "".join(self.confusable.get(c, c) for c in ud.normalize("NFD", look))

    def forms(self, word: str) -> tuple[str, str]:
        """The look of a folded word and its spelling by the table, kept for words that come up again."""
        found = self._forms.get(word)
        if found is None:
            look = self.look(word)
            found = look, self.by_table(look)
            if len(word) <= 64:  # only what is kept is bounded
                if len(self._forms) >= 200_000:
                    self._forms.clear()
                self._forms[word] = found
        return found

    def _letters(self, look: str) -> tuple[set[str], set[str]]:
        """A look's Latin letters, and the scripts of its other ones."""
        letters = {c for c in (look if look.isascii() else ud.normalize("NFD", look)) if c.isalpha()}
        return {c for c in letters if c.isascii()}, {script(c) for c in letters if not c.isascii()}

    def by_table(self, look: str) -> str:
        """The spelling of a look no vocabulary knows."""
        if look.isascii():
            return look
        latin, others = self._letters(look)
        back = self.back.get(next(iter(others)), {}) if len(others) == 1 else {}
        if not latin or not latin <= back.keys():
            return look
        return ud.normalize("NFC", ud.normalize("NFD", look).translate({ord(x): c for x, c in back.items()}))

    def undecided(self, look: str) -> bool:
        """Whether only a vocabulary can tell a word's script: another script has all its letters too."""
        latin, others = self._letters(look)
        return bool(latin) and not others and any(latin <= back.keys() for back in self.back.values())

    def pure(self, word: str) -> bool:
        """Whether a word as it is written is of one script and without disguise."""
        if word.isascii():
            return any(c.isalpha() for c in word)
        scripts = {script(c) for c in ud.normalize("NFD", word) if c.isalpha()}
        return len(scripts) == 1 and scripts <= {"LATIN", *self.back} | UNCASED and folded(word) == word


def script(letter: str) -> str:
    """The script of a letter, the first word of its name."""
    return ud.name(letter, "?").partition(" ")[0]


#: Scripts without case whose words can be vocabulary.
UNCASED = {"HEBREW", "ARABIC"}


class Trie:
    """A vocabulary by letters, traversed under an edit automaton with costs."""

    def __init__(self, words: dict[str, int], looks: Looks):
        self.looks, self.root = looks, {}
        for word, n in words.items():
            at = self.root
            for ch in ud.normalize("NFD", word):
                at = at.setdefault(ch, {})
            at.setdefault("", []).append((word, n))

    def _step(self, a: str, b: str, edit: float) -> float:
        shown, known = self.looks.shown, self.looks.confusable
        if a == b or shown.get(a, a) == shown.get(b, b):
            return 0.0
        return HALF if a.isalpha() and b.isalpha() and known.get(a, a) == known.get(b, b) else edit

    def matches(self, query: str, budget: float = 0.0, edit: float = EDIT) -> list[tuple[float, str, int]]:
        """cost, word, count of every word within the budget, the best first.

        The automaton's states are places in the query; they are carried down the trie,
        each with its least cost. A letter that looks the same, and an ignorable one left
        out of the query, cost nothing, a confusable one `HALF`; any other change, gap or
        addition costs `edit`.
        """
        query = ud.normalize("NFD", query)
        n, found = len(query), []

        def skips(states: dict[int, float]) -> dict[int, float]:
            todo = list(states)
            while todo:
                i = todo.pop()
                if i < n:
                    cost = states[i] + (0.0 if _FOLDS[ord(query[i])] == "" else edit)
                    if cost <= budget and cost < states.get(i + 1, budget + 1):
                        states[i + 1] = cost
                        todo.append(i + 1)
            return states

        stack = [(self.root, skips({0: 0.0}))]
        while stack:
            node, states = stack.pop()
            for ch, child in node.items():
                if ch == "":
                    found += [(states[n], word, k) for word, k in child if n in states]
                    continue
                after: dict[int, float] = {}
                for i, cost in states.items():
                    if cost + edit <= budget:  # a letter of the word that the query lacks
                        after[i] = min(after.get(i, budget + 1), cost + edit)
                    if i < n:
                        step = cost + self._step(query[i], ch, edit)
                        if step <= budget:
                            after[i + 1] = min(after.get(i + 1, budget + 1), step)
                if after:
                    stack.append((child, skips(after)))
        return sorted(found, key=lambda f: (f[0], -f[2], f[1]))


WORDS = "word string, n bigint, key string, asked boolean, pure boolean"


def corpus_words(docs: DataFrame, looks: Looks, text: str = "text") -> DataFrame:
    """word, n, key, asked, pure: every word of all texts as it is written, ignorable characters and all, with its count.

    key: the skeleton of its look; asked: whether a vocabulary has to tell its spelling;
    pure: whether it is vocabulary itself.
    """
    of = docs.sparkSession.sparkContext.broadcast(looks)  # of Unicode's size, whatever the texts

    def rows(seen: Counter[str]) -> pd.DataFrame:
        out = []
        for word, n in seen.items():
            look, pure = of.value.look(folded(word)), of.value.pure(word)
            out.append((word, n, of.value.skeleton(look), not pure or of.value.undecided(look), pure))
        return pd.DataFrame(out, columns=["word", "n", "key", "asked", "pure"]).astype({"n": "int64", "asked": bool, "pure": bool})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch["text"]:
                seen.update((WORD if t.isascii() else RAW_WORD).findall(t))
                if len(seen) > 100_000:
                    yield rows(seen)
                    seen.clear()
        yield rows(seen)

    words = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInPandas(count, WORDS)
    return words.groupBy("word").agg(F.sum("n").alias("n"), *(F.max(c).alias(c) for c in ("key", "asked", "pure")))


def spellings(words: DataFrame, looks: Looks, shards: int | None = None) -> DataFrame:
    """look, spelling: the looks whose canonical spelling isn't the one by the table.

    words: of `corpus_words`. Only words that share a key with one that is asked for are
    kept. They are dealt to shards by key, so that all words that can match, at any cost
    within the budget, meet; each shard has its own trie.
    """
    of = words.sparkSession.sparkContext.broadcast(looks)
    kept = words.join(words.where("asked").select("key").distinct(), "key", "left_semi").where("asked or pure")
    if shards is None:
        kept, _ = written(kept)
        shards = max(1, math.ceil(kept.count() / SHARD))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        looks = of.value
        trie = Trie({w: n for w, n, pure in zip(group["word"], group["n"], group["pure"]) if pure}, looks)

        def best(query: str, look: str) -> str | None:
            found = trie.matches(query, BUDGET)
            # of equally frequent spellings the one by the table, then the first in code order
            return min(found, key=lambda f: (f[0], -f[2], f[1] != looks.by_table(look), f[1]))[1] if found else None

        out: dict[str, str] = {}
        for word in sorted(group["word"][group["asked"]]):
            look = looks.look(folded(word))
            if look not in out:
                found = best(word, look)
                if found is not None and looks.look(found) != look:  # confusable: as that word is itself spelled
                    found = best(found, looks.look(found))
                out[look] = looks.by_table(look) if found is None else found
        return pd.DataFrame([(k, v) for k, v in out.items() if v != looks.by_table(k)], columns=["look", "spelling"])

    dealt = kept.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(choose, "look string, spelling string")


def canonical_text(text: str, chosen: dict[str, str], looks: Looks) -> str:
    """The canonical form of a text, given the spellings that differ from the table's."""
    def one(m: re.Match) -> str:
        word = m.group()
        if word.isascii():
            return chosen.get(word, word)
        look, spelled = looks.forms(word)
        return chosen.get(look) or spelled

    return WORD.sub(one, folded(text))


#: Most spellings that are sent to every executor; beyond it they are joined to the texts.
BROADCAST_SPELLINGS = 200_000
CANONICAL = "canonical string, look_hash string, text_hash string"


def canonicalize(docs: DataFrame, id: str = "doc_id", text: str = "text", max_broadcast: int = BROADCAST_SPELLINGS) -> DataFrame:
    """id, canonical, look_hash, text_hash for each row of docs.

    Two texts have the same look_hash exactly if they look the same, and the same
    text_hash exactly if they are the same. A null text has nulls; an empty text, or one
    of invisible characters only, is canonical as the empty text.
    """
    looks = Looks.of(docs.sparkSession)
    words, words_at = written(corpus_words(docs, looks, text))
    chosen, _ = written(spellings(words, looks))
    drop_written(docs.sparkSession, words_at)
    of = docs.sparkSession.sparkContext.broadcast(looks)
    d = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    out = f"id {docs.schema[id].dataType.simpleString()}, {CANONICAL}"

    def rows(batch: pd.DataFrame, forms: list[str | None]) -> pd.DataFrame:
        digest = lambda t: None if t is None else hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        return pd.DataFrame({"id": batch["id"], "canonical": forms, "look_hash": [digest(f) for f in forms], "text_hash": [digest(t) for t in batch["text"]]})

    if chosen.count() <= max_broadcast:
        table = docs.sparkSession.sparkContext.broadcast({r["look"]: r["spelling"] for r in chosen.collect()})

        def by_broadcast(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield rows(batch, [None if t is None else canonical_text(t, table.value, of.value) for t in batch["text"]])

        return d.mapInPandas(by_broadcast, out).withColumnRenamed("id", id)

    def looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = {(k, of.value.look(w)) for k, t in zip(batch["key"], batch["text"]) for w in set(WORD.findall(folded(t)))}
            yield pd.DataFrame(sorted(pairs), columns=["key", "look"])

    def by_column(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield rows(batch, [None if t is None else canonical_text(t, dict(c) if c is not None else {}, of.value) for t, c in zip(batch["text"], batch["chosen"])])

    keyed = d.withColumn("key", F.sha2("text", 256))
    distinct = keyed.where("text is not null").select("key", "text").mapInPandas(looked_up, "key string, look string").distinct()
    per_text = distinct.join(chosen, "look").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("look", "spelling"))).alias("chosen"))
    joined = keyed.join(per_text, "key", "left").select("id", "text", "chosen")
    return joined.mapInPandas(by_column, out).withColumnRenamed("id", id)


def look_pairs(forms: DataFrame, id: str = "doc_id") -> DataFrame:
    """doc_a < doc_b: texts that look the same but aren't the same characters. forms: of `canonicalize`.

    Variants are paired, then their documents: exact copies of one text are never paired
    with each other, and a look with one variant only is left out before any join.
    """
    f, _ = written(forms.where(F.col(id).isNotNull() & F.col("text_hash").isNotNull()).select(F.col(id).alias("id"), "look_hash", "text_hash"))
    variants = f.select("look_hash", "text_hash").distinct()
    several = variants.groupBy("look_hash").agg(F.count("*").alias("n")).where("n > 1").select("look_hash")
    v, _ = written(variants.join(several, "look_hash", "left_semi"))
    a, b = (v.select("look_hash", F.col("text_hash").alias(n)) for n in ("text_a", "text_b"))
    pairs = a.join(b, "look_hash").where("text_a < text_b").select("text_a", "text_b")
    left = f.select(F.col("id").alias("id_a"), F.col("text_hash").alias("text_a"))
    right = f.select(F.col("id").alias("id_b"), F.col("text_hash").alias("text_b"))
    both = pairs.join(left, "text_a").join(right, "text_b").where("id_a <> id_b")
    return both.select(F.least("id_a", "id_b").alias("doc_a"), F.greatest("id_a", "id_b").alias("doc_b")).distinct()


def look_classes(forms: DataFrame, id: str = "doc_id") -> DataFrame:
    """look_hash, first_doc, n_docs, n_texts: every look that more than one text has, a row each, however many documents share it. forms: of `canonicalize`."""
    f = forms.where(F.col(id).isNotNull() & F.col("text_hash").isNotNull())
    per_text = f.groupBy("look_hash", "text_hash").agg(F.min(id).alias("first_doc"), F.count("*").alias("n_docs"))
    per_look = per_text.groupBy("look_hash").agg(F.min("first_doc").alias("first_doc"), F.sum("n_docs").alias("n_docs"), F.count("*").alias("n_texts"))
    return per_look.where("n_texts > 1")
