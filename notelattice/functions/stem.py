"""English stemming by the published Porter2 (Snowball English) rules, and its Arrow form.

The rules are a few tables of endings and the two regions they apply in. Spark sends token lists as Arrow
arrays; each slice of a batch is dictionary-encoded, so that a word is stemmed once however often it stands
there, and a worker remembers the words it has met last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from notelattice.functions.ship import ship
from notelattice.functions.slices import sliced

#: Words that a worker remembers with their stems: some 20 MB.
REMEMBERED = 1 << 16
#: A text as its number of words and its stems with their numbers.
BAGS = "struct<doc_len: int, bag: array<struct<token: string, tf: bigint>>>"

# Letters, exceptions and endings of the published rules.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
BEFORE_LI = "cdeghkmnrt"
WHOLE_PREFIXES = ("gener", "commun", "arsen")
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURALS = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
DERIVED = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
REDUCED = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
DROPPED = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_REGION = re.compile(f"[{VOWELS}][^{VOWELS}]")
_VOWEL_Y = re.compile(f"([{VOWELS}])y")
_VOWEL = re.compile(f"[{VOWELS}]")
_SHORT_END = re.compile(f"(?:[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]|^[{VOWELS}][^{VOWELS}])$")


def _by_last(endings) -> dict[str, tuple[str, ...]]:
    """Endings by their last letter, the longest first."""
    out: dict[str, tuple[str, ...]] = {}
    for e in sorted(endings, key=len, reverse=True):
        out[e[-1]] = (*out.get(e[-1], ()), e)
    return out


_PLURALS, _FORMS = _by_last(("sses", "ied", "ies", "us", "ss", "s")), _by_last(("eed", "eedly", "ed", "edly", "ing", "ingly"))
_DERIVED, _REDUCED, _DROPPED = _by_last(DERIVED), _by_last(REDUCED), _by_last(DROPPED)


def _longest(word: str, endings: dict[str, tuple[str, ...]]) -> str:
    for e in endings.get(word[-1:], ()):
        if word.endswith(e):
            return e
    return ""


def _after(word: str, start: int) -> int:
    """Where the part behind the first vowel with a consonant begins."""
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


@lru_cache(REMEMBERED)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = word if "y" not in word else _VOWEL_Y.sub(r"\1Y", "Y" + word[1:] if word[0] == "y" else word)
    r1 = next(len(p) for p in WHOLE_PREFIXES if w.startswith(p)) if w.startswith(WHOLE_PREFIXES) else _after(w, 0)
    r2 = _after(w, r1)

    # plurals
    end = _longest(w, _PLURALS)
    if end == "sses":
        w = w[:-2]
    elif end in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif end == "s" and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in KEPT_AFTER_PLURALS:
        return w

    # past and progressive forms
    end = _longest(w, _FORMS)
    if end.startswith("eed"):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    elif end and _VOWEL.search(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT_END.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"

    # endings of derived words, in the first region
    end = _longest(w, _DERIVED)
    before = w[: len(w) - len(end)]
    if end and len(before) >= r1 and (end != "ogi" or before.endswith("l")) and (end != "li" or before[-1:] in tuple(BEFORE_LI)):
        w = before + DERIVED[end]
    end = _longest(w, _REDUCED)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + REDUCED[end]

    # endings in the second region
    end = _longest(w, _DROPPED)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) > r2 or len(w) > r1 and not _SHORT_END.search(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stems(words: Column) -> Column:
    """The stems of a list of lower-case words, in its order; a null list stays null."""
    ship(SparkSession.active())

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from sliced(stemmed, batches)

    return run(words)


def stemmed(lists: pa.Array) -> pa.Array:
    lists = pa.concat_arrays([lists])  # without an offset, as a mask needs it
    coded = lists.values.dictionary_encode()
    known = pa.array([None if w is None else stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    return pa.ListArray.from_arrays(lists.offsets, known.take(coded.indices), mask=lists.is_null() if lists.null_count else None)


def stem_bags(words: Column, left_out: tuple[str, ...] = ()) -> Column:
    """For a list of lower-case words how many of them are not left out (doc_len), and each stem of those with
    its number (bag), so that a text comes back as a row for each distinct stem; a null list has none."""
    ship(SparkSession.active())
    gone = frozenset(left_out)

    @F.arrow_udf(BAGS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from sliced(lambda lists: bagged(lists, gone), batches)

    return run(words)


def bagged(lists: pa.Array, left_out: frozenset[str] = frozenset()) -> pa.Array:
    """One struct (doc_len, bag) for each list."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    known = [None if w is None or w in left_out else stem(w) for w in coded.dictionary.to_pylist()]
    place: dict[str, int] = {}
    number = np.array([-1 if w is None else place.setdefault(w, len(place)) for w in known] or [-1], np.int64)
    own = number[coded.indices.fill_null(0).to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int64)
    row, counted = np.repeat(np.arange(len(lists)), lengths), own >= 0
    if coded.null_count:
        counted &= coded.indices.is_valid().to_numpy(zero_copy_only=False)
    met, tf = np.unique(row[counted] * max(len(place), 1) + own[counted], return_counts=True)
    row, own = np.divmod(met, max(len(place), 1))
    offsets = np.searchsorted(row, np.arange(len(lists) + 1)).astype(np.int32)
    tokens = pa.array(list(place), pa.string()).take(pa.array(own))
    bag = pa.StructArray.from_arrays([tokens, pa.array(tf.astype(np.int64))], ["token", "tf"])
    doc_len = np.bincount(row, tf, len(lists)).astype(np.int32)
    return pa.StructArray.from_arrays([pa.array(doc_len), pa.ListArray.from_arrays(pa.array(offsets), bag)], ["doc_len", "bag"])


def stem_counts(words: Column, wanted: list[str]) -> Column:
    """For a list of words its length and how often each of the wanted stems is in it: all that comes
    back of a text. A stem begins as its word does, so that few distinct words are stemmed."""
    ship(SparkSession.active())
    place, first = {w: i + 1 for i, w in enumerate(wanted)}, frozenset(w[:1] for w in wanted)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from sliced(counted, batches)

    def counted(lists: pa.Array) -> pa.Array:
        lists = pa.concat_arrays([lists])  # without what lies outside of a slice
        coded = lists.values.dictionary_encode()
        number = np.fromiter((place.get(stem(w), 0) if w[:1] in first else 0 for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        found = number[coded.indices.to_numpy(zero_copy_only=False)] if len(number) else np.empty(0, np.int64)
        offsets = lists.offsets.to_numpy()
        at = np.flatnonzero(found)
        at = at[(at >= offsets[0]) & (at < offsets[-1])]
        out = np.zeros((len(lists), 1 + len(place)), np.int32)
        out[:, 0] = np.diff(offsets)
        np.add.at(out, (np.searchsorted(offsets, at, side="right") - 1, found[at]), 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.ravel()))

    return run(words)
