"""Problem 1: personal information inside free text.

Texts are read through a view in which JSON and HTML escapes are single characters,
cut into tokens, and labelled by a skip-chain conditional random field whose skip edges
join repeated and similar tokens of a text: equal up to case and misread digits, or
apart by one letter, or sharing a part of a hyphenated name. What a token says of itself and of its
neighbours goes in as features: spelling, endings, capitals, what kind of number it is,
and word facts (a listed or learned given name, a caption, an ending of street names, a
legal form) at distances up to four. No feature holds the conclusion of the rule that
labels the sample. Features are numbers made by NumPy for all tokens of a batch at once.

The model is fitted on the driver, once for a sample, from at most `most` texts of the
tables themselves, taken in hash order, that a high-precision rule labels: captions,
check digits, the given names of the list and the surname endings that follow them.
Those endings, and given names that the list lacks, are counted over all texts on the
executors. The rule is used for fitting only; every row of a result comes from the
field's labels. A few made-up sentences are always in the sample, so that a small table
has a usable model too.

Where an item begins and ends among characters is decided by the tokens: an e-mail
address, an identity number (with both check digits) or a telephone number is one token,
and the field decides what it is. An address whose domain is neither in the list of
common endings nor written with plain dots is no token, so it can't be found.

Defined results: null and empty texts hold nothing; rows with a null id are left out of
the found cases and keep their text in the masked result; repeated rows are reported
once; text of any length is read whole.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvern.llm.crf import SkipChainCRF
from kvern.session import materialize

#: At most so many sampled texts are used for fitting.
SAMPLE = 4000

LABELS = ["O", "epost", "telefon", "fnr", "adresse", "adresse+", "navn", "navn+"]
CLASSES = [0, 1, 2, 3, 4, 4, 5, 5]
PLACEHOLDER = {"epost": "[EPOST]", "telefon": "[TELEFON]", "fnr": "[FNR]", "adresse": "[ADRESSE]", "navn": "[NAVN]"}

# Identity numbers.
_FIRST = (3, 7, 6, 1, 8, 9, 4, 5, 2)
_SECOND = (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
_MISREAD = str.maketrans("oOsSlIbB", "00551166")
# Words of Norwegian addresses, companies and telephone captions.
STREETS = ("veien", "vegen", "vei", "veg", "gata", "gaten", "gate", "gt", "vn", "svingen", "bakken", "kroken", "tunet", "stien", "lia", "løkka", "torget", "ringen")
STREET_WORDS = {"plass", "allé", "alle", "terrasse", "vei", "veg", "gate", "torg", "brygge"}
STREET_LEADS = {"øvre", "nedre", "gamle", "nye", "nordre", "søndre", "østre", "vestre", "store", "lille"}
COMPANY = {"as", "asa", "ans", "ks", "sa", "da", "ba", "nuf", "sameie", "borettslag", "sparebank", "bank", "stiftelse", "kommune"}
CAPTIONS = {"tlf", "telefon", "tel", "mob", "mobil", "mobiltelefon", "arb", "privat", "ring", "telefonnummer", "telefonnr", "tlfnr", "mobilnr", "faks", "fax"}

_ESCAPE = re.compile(r"\\u[0-9a-fA-F]{4}|\\[nrtbf\"\\/]|&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]{2,8});")
_JSON = {"n": "\n", "r": "\r", "t": "\t", "b": " ", "f": " ", '"': '"', "\\": "\\", "/": "/"}
_TLD = r"(?:test|example|invalid|local|no|com|org|net|se|dk|fi|is|info|eu|uk|de|nu)"
_AT = r"\s?(?:@|[\[({]\s?(?:at|alfa|krøllalfa)\s?[\])}])\s?"
_DOT = r"\s?(?:[.,]|[\[({]\s?(?:dot|punktum)\s?[\])}])\s?"
_MAIL = rf"\w(?:[\w.+-]*\w)?{_AT}(?:[\w-]+(?:{_DOT}[\w-]+)*?{_DOT}{_TLD}(?![\w])|[\w-]+(?:\.[\w-]+)+)"
_FOREIGN = r"(?:(?<![\w+])\+|(?<!\d)00(?=[1-9]))\d(?:[ .\-()]{0,2}\d){6,13}(?!\d)"
_DOMESTIC = r"(?<![\d])(?:\d{8}|\d\d([ .])\d\d\g<sep>\d\d\g<sep>\d\d|\d{3} \d\d \d{3}|\d{4}[ -]\d{4})(?!\d)".replace("([ .])", "(?P<sep>[ .])").replace(r"\g<sep>", "(?P=sep)")
_TOKEN = re.compile(
    rf"(?P<mail>{_MAIL})|(?P<foreign>{_FOREIGN})|(?P<domestic>{_DOMESTIC})|(?P<house>(?:\bnr\.?\s)?(?<![\d.,/:])\d{{1,3}}(?: ?[A-Za-z])?(?![\w.,/:]*\d)(?!\w))"
    r"|(?P<word>(?=\w*[^\W\d_]{2})\w(?:[\w'’]|-(?=\w))*)|(?P<initial>[^\W\d_](?=\.))|(?P<number>\d[\w.,/:-]*\w|\d)|(?P<other>\S)",
    re.IGNORECASE,
)
_ELEVEN = re.compile(r"(?=((?:[0-9oOsSlIbB][ .,_-]{0,2}){10}[0-9oOsSlIbB]))")


def view(text: str) -> tuple[str, list[int] | None]:
    """(text with escapes as single characters, stored position of each character and of the end; None where they are the same)."""
    if "\\" not in text and "&" not in text:
        return text, None
    parts, places, at = [], [], 0
    for m in _ESCAPE.finditer(text):
        e = m.group()
        c = chr(int(e[2:], 16)) if e[:2] == "\\u" else _JSON[e[1]] if e[0] == "\\" else html.unescape(e)
        if len(c) != 1:
            continue
        parts += [text[at : m.start()], c]
        places += [*range(at, m.start()), m.start()]
        at = m.end()
    parts.append(text[at:])
    places += range(at, len(text) + 1)
    return "".join(parts), places


def valid_number(digits: str) -> bool:
    """Eleven digits with the date shape of an identity or D-number and both check digits right."""
    d = [ord(c) - 48 for c in digits]
    day, month = d[0] * 10 + d[1], d[2] * 10 + d[3]
    if not (1 <= day <= 31 or 41 <= day <= 71) or not 1 <= month <= 12:
        return False
    return (11 - sum(w * x for w, x in zip(_FIRST, d)) % 11) % 11 == d[9] and (11 - sum(w * x for w, x in zip(_SECOND, d)) % 11) % 11 == d[10]


def identity_numbers(text: str) -> list[tuple[int, int]]:
    """[start, end) of the identity numbers, left to right without overlap, none inside a longer word or run of digits."""
    found, least = [], 0
    for m in _ELEVEN.finditer(text):
        start, end = m.start(1), m.end(1)
        if start < least:
            continue
        before, after = text[start - 1 : start], text[end : end + 1]
        if before.isalnum() or after.isalnum():
            continue
        body = re.sub(r"[ .,_-]", "", m.group(1))
        if sum(c.isdigit() for c in body) >= 6 and valid_number(body.translate(_MISREAD)):
            found.append((start, end))
            least = end
    return found


def fold(word: str) -> str:
    """Lower case, with the digits of a misread word as letters."""
    w = word.lower()
    return w.translate(str.maketrans("015", "ols")) if not w.isalpha() and any(c.isalpha() for c in w) else w


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the view's tokens."""
    out, at = [], 0
    for s, e in [*identity_numbers(text), (len(text), len(text))]:
        # an e-mail address may hold what looks like a number; such a number stays outside the address here, as it is valid
        out += [(m.lastgroup if m.lastgroup != "sep" else "domestic", m.start(), m.end()) for m in _TOKEN.finditer(text, at, s)]
        if s < e:
            out.append(("fnr", s, e))
        at = e
    return out


class Lexicon:
    """Given names of the list, given names learned from all texts, and endings of surnames."""

    def __init__(self, names: list[str], learned: set[str] = frozenset(), surname: set[str] = frozenset()):
        self.given, self.learned, self.surname = {fold(n) for n in names}, set(learned), set(surname)

    def is_given(self, w: str) -> bool:
        return w in self.given or w in self.learned

    def is_surname(self, w: str) -> bool:
        return all(p[-5:] in self.surname for p in w.split("-")) if w else False


def company_at(t: list[tuple[str, str]], i: int) -> bool:
    """Whether the capitalised word at i begins or continues a company name: a legal form or kind follows over capitalised words, & or og."""
    for k, w in t[i + 1 : i + 5]:
        low = w.lower()
        if low in COMPANY:
            return True
        if not (w == "&" or low == "og" or k == "word" and w[0].isupper()):
            return False
    return False


def _street(t: list[tuple[str, str]], i: int) -> int:
    """Number of tokens of a street name with house number at i, else 0."""
    n = i
    if t[n][0] == "word" and fold(t[n][1]) in STREET_LEADS:
        n += 1
    if n >= len(t) or t[n][0] != "word" or not t[n][1][0].isupper() or fold(t[n][1]) in CAPTIONS:
        return 0
    w = fold(t[n][1])
    end = n + 1
    if w.endswith(("gt", "vn")) and end < len(t) and t[end][1] == ".":
        end += 1
    elif end < len(t) and fold(t[end][1]) in STREET_WORDS:
        end += 1
    elif not (w.endswith(STREETS) and len(w) > 4):
        return 0
    return end + 1 - i if end < len(t) and t[end][0] == "house" else 0


def _caption(t: list[tuple[str, str]], i: int) -> bool:
    return any(k == "word" and w.lower() in CAPTIONS for k, w in t[max(0, i - 4) : i])


def rule_labels(t: list[tuple[str, str]], lex: Lexicon) -> list[int]:
    """High-precision labels of a tokenised text, for fitting only."""
    y = [0] * len(t)
    words = [fold(w) if k == "word" and w[0].isupper() else "" for k, w in t]
    i = 0
    while i < len(t):
        kind = t[i][0]
        if kind == "mail":
            y[i] = 1
        elif kind == "fnr":
            y[i] = 3
        elif kind == "foreign" or kind == "domestic" and _caption(t, i):
            y[i] = 2
        elif n := _street(t, i):
            y[i : i + n] = [4] + [5] * (n - 1)
            i += n
            continue
        else:
            j = i
            if t[i][1].lower() == "e" and i and t[i - 1][1].lower() == "arv":  # "arv e." is an abbreviation
                i += 1
                continue
            while j < len(t) and (words[j] and lex.is_given(words[j]) or t[j][0] == "initial" and t[j][1].isupper() and j + 1 < len(t)):
                j += 2 if t[j][0] == "initial" else 1
            if j > i and j < len(t) and words[j] and lex.is_surname(words[j]) and not company_at(t, j):
                y[i : j + 1] = [6] + [7] * (j - i)
                i = j + 1
                continue
            if words[i] and lex.is_surname(words[i]) and i + 2 < len(t) and t[i + 1][1] == ",":
                j = i + 2
                while j < len(t) and (words[j] and lex.is_given(words[j]) or t[j][0] == "initial" and t[j][1].isupper() and j + 1 < len(t) and t[j + 1][1] == "."):
                    j += 2 if t[j][0] == "initial" else 1
                if j > i + 2:
                    y[i:j] = [6] + [7] * (j - i - 1)
                    i = j
                    continue
        i += 1
    return y


# ----- features

_MASK = (1 << 64) - 1
_CAPITAL, _GIVEN, _LEARNED, _CAPTION, _FIRM, _LINK, _STREET, _STREET_WORD, _LEAD, _HOUSE, _WORDLIKE = (1 << i for i in range(11))
_BESIDE = 4


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Forms:
    """Facts of token forms, each found once: hashes of the form and its endings, its shape and its word facts."""

    def __init__(self, given: set[str], learned: set[str], most: int = 200_000):
        self.given, self.learned, self.most = given, learned, most
        self.clear()

    def clear(self) -> None:
        self.of: dict[tuple[str, str], int] = {}
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.table = np.zeros((0, 6), np.uint64)
        self.number("pad", "")

    def number(self, kind: str, form: str) -> int:
        key = (kind, form)
        at = self.of.get(key)
        if at is None:
            at = self.of[key] = len(self.rows)
            self.rows.append(self._facts(kind, form))
        return at

    def _facts(self, kind: str, form: str) -> tuple[int, int, int, int, int, int]:
        low = fold(form) if kind == "word" else form.lower() if kind in ("other", "initial") else kind
        last = low.rsplit("-", 1)[-1] if kind == "word" else low
        upper = kind == "word" and form[0].isupper()
        shape = ("X" if len(form) > 1 and form.isupper() else "Xx" if upper else "x") if kind == "word" else kind + str(form.isupper()) if kind == "initial" else kind
        flags = 0
        if kind == "word":
            flags |= _WORDLIKE
            flags |= _CAPTION if form.lower() in CAPTIONS else 0
            flags |= _FIRM if form.lower() in COMPANY else 0
            flags |= _LINK if upper or form.lower() == "og" else 0
            flags |= _STREET_WORD if low in STREET_WORDS else 0
            if upper:
                flags |= _CAPITAL | (_GIVEN if low in self.given else 0) | (_LEARNED if low in self.learned else 0) | (_LEAD if low in STREET_LEADS else 0)
                flags |= _STREET if low.endswith(STREETS) and len(low) > 3 else 0
        elif kind == "house":
            flags |= _HOUSE
        elif form == "&":
            flags |= _LINK
        return _hash(low), _hash("5" + last[-5:]), _hash("4" + last[-4:]), _hash("3" + last[-3:]), _hash("s" + shape), flags

    def array(self) -> np.ndarray:
        if len(self.table) < len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :], np.uint64)])
        return self.table


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def feature_hashes(forms: np.ndarray) -> np.ndarray:
    """(tokens, features) hashes for a row of form facts with _BESIDE pad rows at both ends; the pads get none."""
    n = len(forms) - 2 * _BESIDE
    at = lambda d: forms[_BESIDE + d : _BESIDE + d + n]
    low, e5, e4, e3, shape, flags = (lambda d, i=i: at(d)[:, i] for i in range(6))
    has = lambda d, bit: (flags(d) & np.uint64(bit)) != 0
    named = lambda d: (flags(d) & np.uint64(_CAPITAL | _GIVEN | _LEARNED)) + np.uint64(1)
    none = np.zeros(n, np.uint64)
    out: list[np.ndarray] = []

    def add(*parts: np.ndarray, when: np.ndarray | None = None) -> None:
        h = np.full(n, np.uint64((len(out) + 1) * 0xD6E8FEB86659FD93 & _MASK))
        for p in parts:
            h = _mixed(h + p)
        out.append(h if when is None else np.where(when, h, none))

    def distance(bit: int, steps) -> np.ndarray:
        """The first of the steps where a token has the fact, counted from 1; 0 where none has."""
        first = np.zeros(n, np.uint64)
        for k, d in reversed(list(enumerate(steps, 1))):
            first = np.where(has(d, bit), np.uint64(k), first)
        return first

    add(none)
    add(shape(0))
    add(low(0))
    for d in (-2, -1, 1, 2):
        add(low(d))
        add(shape(d))
        add(e5(d), when=has(d, _CAPITAL))
        add(named(d), when=has(d, _CAPITAL))
    word, capital = has(0, _WORDLIKE), has(0, _CAPITAL)
    add(e3(0), when=word)
    add(e4(0), when=word)
    add(e5(0), when=word)
    add(shape(0), e5(0), when=word)
    # a legal form after the word, over capitalised words, & and og
    firm, going = np.zeros(n, np.uint64), np.ones(n, bool)
    for d in range(1, _BESIDE + 1):
        firm = np.where(going & has(d, _FIRM) & (firm == 0), np.uint64(d), firm)
        going &= has(d, _LINK) & ~has(d, _FIRM)
    follows = np.where(has(1, _WORDLIKE), shape(1), low(1))
    add(named(0), when=capital)
    add(firm, when=capital)
    add(firm, e5(0), when=capital)
    add(named(0), e5(1), when=capital)
    add(named(0), named(1), shape(1), when=capital)
    add(named(-1), named(0), shape(-1), when=capital)
    add(e5(0), follows, when=capital)
    add(e5(0), low(1), named(2), shape(2), when=capital)
    add(e5(0), low(-1), named(-2), when=capital)
    add(shape(-1), shape(0), shape(1))
    # a street name before a house number, word by word
    house, street = distance(_HOUSE, (1, 2, 3)), (flags(0) & np.uint64(_STREET | _STREET_WORD | _LEAD))
    add(house, when=word)
    add(house, street, when=word)
    add(house, street, flags(1) & np.uint64(_STREET | _STREET_WORD), when=capital)
    add(house, e3(0), when=capital)
    back = [flags(-d) & np.uint64(_STREET | _STREET_WORD | _CAPITAL) for d in (1, 2, 3)]
    add(shape(0), back[0])
    add(shape(0), back[0], back[1], low(-1))
    add(shape(0), back[1], low(-1), when=~has(-1, _WORDLIKE))
    add(shape(0), e3(-1))
    # a caption before a number
    add(shape(0), distance(_CAPTION, (-1, -2, -3, -4)), when=~word)
    return np.stack(out, axis=1)


_PARTS_LEAST = 4


def _alike(w: str) -> list[str]:
    """Keys that two forms share when one letter differs, is missing or was added, or when they share a part of a hyphenated name."""
    keys = [w[:i] + "\0" + w[i + 1 :] for i in range(len(w))] + [w[:i] + "\0" + w[i:] for i in range(len(w) + 1)] if 5 <= len(w) <= 40 else []
    parts = w.split("-")
    return keys + [p for p in parts if len(p) >= _PARTS_LEAST] if len(parts) > 1 else keys + [w]


def skip_edges(t: list[tuple[str, str]]) -> list[tuple[int, int, int]]:
    """(earlier, later, kind) of capitalised words of four letters or more, long numbers and addresses of mailboxes.

    Kind 0 joins a token to the last one of the same form, up to case and misread digits; kind 1 joins a word without such
    a one to the last similar word.
    """
    same: dict[str, int] = {}
    near: dict[str, int] = {}
    edges = []
    for i, (k, w) in enumerate(t):
        if k == "word" and len(w) >= _PARTS_LEAST and w[0].isupper():
            key = fold(w)
        elif k in ("fnr", "domestic", "foreign"):
            key = re.sub(r"\D", "", w.translate(_MISREAD))
        elif k == "mail":
            key = re.sub(r"\s", "", w.lower())
        else:
            continue
        if key in same:
            edges.append((same[key], i, 0))
        if k == "word":
            keys = _alike(key)
            if key not in same:
                like = max((near[x] for x in keys if x in near), default=-1)
                if like >= 0:
                    edges.append((like, i, 1))
            near.update(dict.fromkeys(keys, i))
        same[key] = i
    return edges


class Finder:
    """A fitted model: finds (kind, start, end) in stored texts."""

    def __init__(self, model: SkipChainCRF, lexicon: Lexicon, known: np.ndarray, linked: bool = True):
        self.model, self.lexicon, self.known, self.linked = model, lexicon, known, linked
        self.forms: Forms | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"forms": None}

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """Feature numbers: the place among the known hashes and 1, 0 for others."""
        if not len(self.known):
            return np.zeros(hashes.shape, np.int32)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where((self.known[at] == hashes) & (hashes != 0), at + 1, 0).astype(np.int32)

    def rows(self, texts: list[list[tuple[str, str]]]) -> np.ndarray:
        """Form numbers of all tokens in a row, pads between the texts and at both ends."""
        if self.forms is None:
            self.forms = Forms(self.lexicon.given, self.lexicon.learned)
        elif len(self.forms.rows) > self.forms.most:
            self.forms.clear()
        number, pads, out = self.forms.number, [0] * _BESIDE, [0] * _BESIDE
        for t in texts:
            out += [number(k, w) for k, w in t]
            out += pads
        return np.array(out, np.int64)

    def emissions(self, texts: list[list[tuple[str, str]]], piece: int = 1 << 14) -> list[np.ndarray]:
        """The emissions of each text's tokens, in pieces of so many tokens."""
        rows = self.rows(texts)
        facts = self.forms.array()
        n = len(rows) - 2 * _BESIDE
        flat = np.empty((max(n, 0), len(self.model.labels)))
        for at in range(0, n, piece):
            upto = min(n, at + piece)
            flat[at:upto] = self.model.emissions(self.numbered(feature_hashes(facts[rows[at : upto + 2 * _BESIDE]])))
        out, at = [], 0
        for t in texts:
            out.append(flat[at : at + len(t)])
            at += len(t) + _BESIDE
        return out

    def find(self, texts: list[str], chars: int = 1 << 20) -> list[list[tuple[str, int, int]]]:
        """The items of each text; texts are read so many characters (or one longer text) at a time."""
        out, at = [], 0
        while at < len(texts):
            upto, held = at, 0
            while upto < len(texts) and (upto == at or held + len(texts[upto]) <= chars):
                held += len(texts[upto])
                upto += 1
            out += self._find(texts[at:upto])
            at = upto
        return out

    def _find(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        views = [view(x) for x in texts]
        cut = [tokens(v) for v, _ in views]
        forms = [[(k, v[s:e]) for k, s, e in c] for c, (v, _) in zip(cut, views)]
        paths = self.model.decode(self.emissions(forms), [skip_edges(t) if self.linked else [] for t in forms])
        out = []
        for path, c, (_, places) in zip(paths, cut, views):
            spans, at = [], 0
            while at < len(path):
                label = LABELS[path[at]].rstrip("+")
                end = at + 1
                if path[at] in (4, 5, 6, 7):
                    inside = LABELS.index(label + "+")
                    while end < len(path) and path[end] == inside:
                        end += 1
                if path[at]:
                    s, e = c[at][1], c[end - 1][2]
                    spans.append((label, places[s], places[e]) if places else (label, s, e))
                at = end
            out.append(spans)
        return out


#: Made-up sentences that are always part of the sample, with {g} given name, {s} surname.
_SEED = (
    "Selger {g} {s} og kjøper {s}, {g}", "Vitne: {g} {s}. Vitne: {s}, {g}.", "tlf. 22 33 44 55", "telefon privat 22334455, arb. +47 223 34 455", "saksnr 22334455",
    "Bopel: Kirkeveien 12, 1234 Nordvollen", "Postadresse Øvre Skogbakken 7B", "langs Kirkegata til grensepunkt 14", "Hjemmelshaver: {g} {s}, f. 010203", "e-post: per.ola@post.example",
    "Rammen treffer e-posten ola.per [at] post.example, ikke et tall.", "org.nr. 912 345 678 {s} Maskin AS", "{s} borettslag v/{g} {s}", "skjøte 20170439 fra {s} & Sønn AS", "lån @ 4,5 % rente", "Gate og fortau 12 m",
    "Bjørn og Vår bruk, gnr. 12 bnr. 3", "Dag for overtagelse: 010203", "Mob 22334455 e-post ola@post.example", "Lia terrasse 14 / +46 70-123 45 67",
)


def fit(texts: list[str], lexicon: Lexicon, epochs: int = 6) -> Finder:
    """Fit on texts labelled by the rule; the result depends on the texts, not on their order of arrival."""
    seeds = sorted(lexicon.given)[:4] or ["ola", "kari"]
    made = [x.format(g=g.title(), s=s) for x in _SEED for g in seeds for s in ("Nordviksandmo", "Sørtangmo")]
    if not lexicon.surname:
        lexicon = Lexicon(lexicon.given, lexicon.learned, {"andmo", "angmo"})
    forms = []
    for x in sorted(set(texts)) + made:
        v, _ = view(x)
        forms.append([(k, v[s:e]) for k, s, e in tokens(v)])
    gold = [rule_labels(t, lexicon) for t in forms]
    finder = Finder(SkipChainCRF(LABELS, CLASSES), lexicon, np.zeros(0, np.uint64))
    rows = finder.rows(forms)
    facts = finder.forms.array()
    hashes = [feature_hashes(facts[rows[at : at + (1 << 14) + 2 * _BESIDE]]) for at in range(0, len(rows) - 2 * _BESIDE, 1 << 14)]
    finder.known = np.unique(np.concatenate([h.ravel() for h in hashes]))
    finder.known = finder.known[finder.known != 0]
    flat = np.concatenate([finder.numbered(h) for h in hashes])
    ids, at = [], 0
    for t in forms:
        ids.append(flat[at : at + len(t)])
        at += len(t) + _BESIDE
    finder.model.fit(ids, len(finder.known) + 1, gold, [skip_edges(t) for t in forms], epochs=epochs)
    finder.forms = None
    return finder


def fields(manifest: DataFrame, verdicts: DataFrame) -> DataFrame:
    """felt, rad_id, tekst of every text field, repeated rows once."""
    parts = [
        manifest.select(F.lit("ocr_tekst").alias("felt"), F.col("nr").cast("bigint").alias("rad_id"), F.col("ocr_tekst").alias("tekst")),
        *[verdicts.select(F.lit(c).alias("felt"), F.col("verdict_id").cast("bigint").alias("rad_id"), F.col(c).alias("tekst")) for c in ("raatekst", "begrunnelse")],
    ]
    return parts[0].union(parts[1]).union(parts[2])


def _pairs(texts: DataFrame, names: DataFrame) -> DataFrame:
    """w, f, w_given, f_given, firm, comma, n: how often the capitalised word w of all texts is followed by f (blank where that isn't capitalised), folded, and what comes next."""
    word = r"([\p{L}\d][\p{L}\d'’]*(?:-[\p{L}\d'’]+)*|[^\s])"
    cut = texts.select(F.regexp_extract_all("tekst", F.lit(word)).alias("a")).where(F.size("a") > 0)
    at = lambda i: F.coalesce(F.get("a", i), F.lit(""))
    three = cut.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("a") - 1), lambda i: F.struct(at(i).alias("w"), at(i + 1).alias("f"), at(i + 2).alias("t")))).alias("s")).select("s.*")
    folded = lambda c: F.when(F.col(c).rlike(r"^\p{Lu}.*\p{L}"), F.when(F.col(c).rlike("[0-9]"), F.translate(F.lower(c), "015", "ols")).otherwise(F.lower(c))).otherwise("")
    rows = three.select(folded("w").alias("w"), folded("f").alias("f"), F.lower("t").isin(*sorted(COMPANY), "&", "og").alias("firm"), (F.col("t") == ",").alias("comma")).where("w <> '' or f <> ''")
    counted = rows.groupBy("w", "f", "firm", "comma").agg(F.count(F.lit(1)).alias("n"))
    listed = names.select(F.lower(F.trim("navn")).alias("g")).where("g <> ''").distinct()
    out = counted
    for c in "wf":
        out = out.join(listed.select(F.col("g").alias(c), F.lit(True).alias(f"{c}_given")), c, "left").withColumn(f"{c}_given", F.coalesce(f"{c}_given", F.lit(False)))
    return out


def lexicon(texts: DataFrame, names: DataFrame) -> Lexicon:
    """What all texts show of names: only endings and words that pass the counts come to the driver.

    A surname ending often follows a listed given name and is seldom followed by
    another such word; a learned given name mostly stands directly before a surname.
    """
    spark = texts.sparkSession
    given = [r[0] for r in names.select(F.trim("navn").alias("n")).where("n <> ''").distinct().collect()]
    pairs = materialize(_pairs(texts, names))
    end = lambda c: F.substring(c, -5, 5)
    ends = pairs.where(F.length("w") > 5).groupBy(end("w").alias("e")).agg(F.sum("n").alias("seen"))
    after = pairs.where(F.col("w_given") & ~F.col("f_given") & (F.length("f") > 5)).groupBy(end("f").alias("e")).agg(F.sum("n").alias("n"))
    first = materialize(after.join(ends, "e").where("n >= 3 and n >= 0.05 * seen").select("e", "seen"))
    leading = pairs.where((F.length("w") > 5) & (F.col("f") != "")).select(end("w").alias("e"), end("f").alias("f"), "n").join(first.select(F.col("e").alias("f")), "f", "left_semi").groupBy("e").agg(F.sum("n").alias("n"))
    surnames = materialize(first.join(leading, "e", "left").where("coalesce(n, 0) < 0.2 * seen").select("e"))
    surname = {r[0] for r in surnames.collect()}
    if not surname:
        return Lexicon(given)
    # words whose hyphenated parts all end like surnames
    words = pairs.select(F.col("w").alias("x")).union(pairs.select("f")).where("x <> ''").distinct()
    parts = words.select("x", F.explode(F.split("x", "-")).alias("p")).select("x", end("p").alias("e"))
    are = materialize(parts.join(surnames.withColumn("s", F.lit(1)), "e", "left").groupBy("x").agg(F.bool_and(F.col("s").isNotNull()).alias("s")).where("s").select("x"))
    known = pairs.join(are.select(F.col("x").alias("w")), "w", "left_anti").where("w <> ''")
    known = materialize(known.join(are.select(F.col("x").alias("f"), F.lit(True).alias("f_surname")), "f", "left").withColumn("f_surname", F.coalesce("f_surname", F.lit(False))))
    learned: set[str] = set()
    for _ in range(2):
        also = spark.createDataFrame([(w,) for w in sorted(learned)], "f string").withColumn("f_learned", F.lit(True))
        sums = known.join(also, "f", "left").groupBy("w", "w_given").agg(
            F.sum("n").alias("seen"), F.sum(F.when(F.col("f_surname") & ~F.col("comma") & ~F.col("firm"), F.col("n")).otherwise(0)).alias("direct"),
            F.sum(F.when(~F.col("f_surname") & (F.col("f_given") | F.coalesce("f_learned", F.lit(False))), F.col("n")).otherwise(0)).alias("before_given"),
        )
        learned = {r[0] for r in sums.where("not w_given and direct >= 3 and direct >= 0.3 * seen and direct >= before_given").select("w").collect()}
    return Lexicon(given, learned, surname)


_fitted: dict[str, Finder] = {}


def fitted(texts: DataFrame, names: DataFrame, most: int = SAMPLE) -> Finder:
    """The model of a bounded sample: the `most` distinct texts with the smallest hashes, labelled with the lexicon of all texts.

    A model is fitted once in a driver for the same sample and lexicon.
    """
    kept = texts.where("tekst is not null and tekst <> ''").select("tekst").distinct()
    known = lexicon(kept, names)
    sample = [r[0] for r in kept.orderBy(F.xxhash64("tekst"), "tekst").limit(most).collect()]
    said = "\0".join(["\1".join(sorted(s)) for s in (known.given, known.learned, known.surname)] + sorted(sample))
    key = hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _fitted:
        _fitted.clear()
        _fitted[key] = fit(sample, known)
    return _fitted[key]


def occurrences(manifest: DataFrame, verdicts: DataFrame, names: DataFrame, most: int = SAMPLE) -> DataFrame:
    """felt, rad_id, art, start_pos, slutt_pos of each occurrence, positions in the stored text."""
    texts = fields(manifest, verdicts)
    sent = texts.sparkSession.sparkContext.broadcast(fitted(texts, names, most))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(felt, rad, *span) for felt, rad, spans in zip(frame.felt, frame.rad_id, sent.value.find(frame.tekst.tolist())) for span in spans]
            yield pd.DataFrame(found, columns=["felt", "rad_id", "art", "start_pos", "slutt_pos"])

    usable = texts.where("rad_id is not null and tekst is not null and tekst <> ''").distinct()
    return usable.mapInPandas(run, "felt string, rad_id bigint, art string, start_pos int, slutt_pos int").distinct()


def masked(manifest: DataFrame, verdicts: DataFrame, names: DataFrame, most: int = SAMPLE) -> DataFrame:
    """felt, rad_id, tekst, n: every text with typed placeholders in place of what was found, all else unchanged."""
    texts = fields(manifest, verdicts)
    sent = texts.sparkSession.sparkContext.broadcast(fitted(texts, names, most))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            stored = [x if isinstance(x, str) else None for x in frame.tekst]
            done, counts = [], []
            for x, spans in zip(stored, sent.value.find([x or "" for x in stored])):
                at, parts = 0, []
                for kind, s, e in spans:
                    parts += [x[at:s], PLACEHOLDER[kind]]
                    at = e
                done.append(None if x is None else "".join(parts) + x[at:])
                counts.append(len(spans))
            yield pd.DataFrame({"felt": frame.felt, "rad_id": frame.rad_id.astype("Int64"), "tekst": done, "n": counts})

    return texts.distinct().mapInPandas(run, "felt string, rad_id bigint, tekst string, n int")
