"""Personal data by weak supervision.

Fixed patterns give the base spans (email, ip, card, phone), which always stay. Beside them stand candidates of three kinds:

- secrets: tokens that no pattern knows, if they are long and have a digit, or follow an announcing word or an assignment;
- names: one to three capitalised words after a title or an introduction, or two and more that begin with a given name;
- addresses: house numbers with capitalised words and a word for a street, in the usual orders of four languages.

For each kind, labelers by pattern, gazetteer and context vote on every candidate, expectation-maximisation estimates how
reliable they are (those of exact forms have stated odds), and a logistic classifier of the span's own shape, formats and
surroundings, trained on the posteriors, decides which candidates are spans. Votes and features have few values, so what is
estimated over all candidates of all texts are counts of their combinations; texts and spans never go to the driver.

Null texts count as empty. Each row is judged by its text (and the corpus-wide estimates), so null or repeated ids and
extra columns change nothing, and repeated rows give the same spans. Positions are code points, ends exclusive. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import weak
from .shared import materialize

#: The base patterns. Those of emails and addresses are tried only where they can begin or must pass, so that long
#: runs of their characters are read once; the plain forms are in the tests.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "secret", "name", "address")

_KEY = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|[0-9a-f]{16,}|[0-9A-F]{16,}|eyJ[\w-]{10,}|sk-[\w-]{16,}")
_NATIONAL = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
#: Gazetteers: words that announce a secret or personal number, and beginnings of harmless tokens.
ANNOUNCE = ("token", "password", "passwd", "pwd", "secret", "key", "auth", "bearer", "credential", "ssn", "iban", "passport", "account")
HARMLESS = ("http", "www", "v0", "v1", "v2", "v3", "utf", "iso", "rfc", "sha", "md5", "page", "fig", "img", "section")
_ASSIGNED = re.compile(r"[=:]\s{0,2}[\"'`]?$")
_ANNOUNCED = re.compile(r"(?i)(?:" + "|".join(ANNOUNCE) + r")\W{0,6}(?:is\W{1,3})?$")
_PART = re.compile(r"[0-9]+")
_OUTSIDE = re.compile(r"[^A-Za-z0-9_+/-]")
_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-"
_INSIDE = frozenset(_SIGNS)
_TOKEN = re.compile(r"[A-Za-z0-9_+/-]+")
_WORDY = re.compile(r"[A-Za-z0-9]")
_OPENS = re.compile(r"(?i)" + "|".join((*ANNOUNCE, "=", ":")))
#: Of tokens that nothing announces. After an opening, a token starts within REACH characters: what _ANNOUNCED and _ASSIGNED allow.
SHORTEST = 9
REACH = 11

LABELERS = ("key_format", "national_format", "announced", "assigned", "mixture", "harmless", "announced_value")
#: Outcome shares to start from. Those of the labelers in EXACT stay: few candidates have these forms, and among many dates
#: or assignments, estimates would take them for chance. A national format hardly ever occurs by chance, so that it needs
#: no announcement.
START = np.array([[[0.30, 0.65, 0.05], [0.03, 0.55, 0.42]]] * len(LABELERS))
EXACT = tuple(LABELERS.index(x) for x in ("national_format", "announced_value"))
START[EXACT[0]] = [[0.001, 0.99899, 0.00001], [0.001, 0.579, 0.42]]
START[EXACT[1]] = [[0.001, 0.994, 0.005], [0.001, 0.579, 0.42]]
FEATURES = (
    "digits_third", "long", "upper_only", "lower_only", "letters", "many_switches", "assigned", "announced", "quoted", "dashes",
    "key_format", "national_format", "digit", "announced_value",
)
#: Gazetteers of names and addresses (English, German, French, Spanish).
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Herrn", "Frau", "Monsieur", "Madame", "Mme", "Mlle", "Señor", "Señora", "Sr", "Sra")
INTRODUCED = (
    "my name is", "name", "signed", "contact", "attn", "attention", "regards", "sincerely", "dear", "mein name ist", "ich heiße", "grüße", "je m'appelle",
    "nom", "cordialement", "me llamo", "mi nombre es", "nombre", "atentamente",
)
GIVEN = (
    "Alice", "Andrea", "Andreas", "Anna", "Anne", "Antonio", "Carlos", "Carmen", "Charles", "Christian", "Claire", "Claudia", "Daniel", "David", "Elena",
    "Elizabeth", "Emily", "Emma", "Francisco", "Hans", "Isabel", "James", "Jan", "Javier", "Jean", "Jennifer", "John", "Jose", "José", "Juan", "Julia", "Julie",
    "Karl", "Katharina", "Laura", "Linda", "Lucia", "Luis", "Manuel", "Maria", "María", "Marie", "Mark", "Martin", "Mary", "Michael", "Michel", "Miguel", "Nicolas",
    "Patricia", "Paul", "Peter", "Philippe", "Pierre", "Robert", "Sabine", "Sarah", "Sophie", "Stefan", "Susan", "Thomas", "Ursula", "William", "Wolfgang",
)
NO_NAMES = (
    "January", "February", "March", "April", "June", "July", "August", "September", "October", "November", "December", "Monday", "Tuesday", "Wednesday",
    "Thursday", "Friday", "Saturday", "Sunday", "The", "This", "That", "Reader", "Readers", "Sir", "Madam", "Customer", "Customers", "Team", "All", "Us", "Me",
)
STREETS = ("Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Ln", "Drive", "Boulevard", "Blvd", "Court", "Way", "Place", "Square", "Terrace")
_CAPITAL = "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’-]{1,24}"
_FULL = re.compile(rf"{_CAPITAL}(?: {_CAPITAL}){{0,2}}(?!\w)")
# Each begins with a set of first letters, which is quick to look for; what may stand before is checked apart.
_TITLED = re.compile(rf"(?:{'|'.join(TITLES)})\.? (?={_CAPITAL})")
_INTRO = re.compile(rf"(?i:(?:{'|'.join(INTRODUCED)})[:,]?\s{{1,2}})(?={_CAPITAL})")
_GIVEN = re.compile(rf"(?=[{''.join(sorted({g[0] for g in GIVEN}))}])(?=(?:{'|'.join(GIVEN)}) {_CAPITAL})")
_HOUSE_FIRST = re.compile(
    rf"[0-9]{{1,5}}(?:[a-z]? (?:{_CAPITAL} ){{1,3}}(?:{'|'.join(STREETS)})(?!\w)|,? (?:rue|avenue|boulevard|place|chemin) (?:(?:de|du|des|la|le) ){{0,2}}{_CAPITAL})"
)
_STREET_FIRST = re.compile(rf"(?:Calle|Avenida|Plaza|Paseo) (?:(?:de|del|la|los) ){{0,2}}{_CAPITAL},? [0-9]{{1,4}}(?!\w)")
_STREET_ENDS = ("straße ", "strasse ", "weg ", "platz ", "allee ", "gasse ")
_ONE_WORD = re.compile(rf"{_CAPITAL[:-6]}{{0,24}}(?:{'|'.join(x.strip() for x in _STREET_ENDS)}) [0-9]{{1,4}}[a-z]?(?!\w)")
_LIVES = re.compile(r"(?i)(?:address|adresse|dirección|lives? at|living at|ship to|deliver(?:ed)? to|wohnhaft|wohnt|habite|vive en|domicilio)\W{0,3}(?:is\W|in\W|au\W|en\W)?$")
_POSTCODE = re.compile(r"[,;]?\s{1,2}(?:[A-Z]{1,2}[0-9][0-9A-Z]? [0-9][A-Z]{2}|(?:[A-Z]{2} |[A-Z][\w-]{1,20},? (?:[A-Z]{2} )?)?[0-9]{4,5})(?![0-9])")
NAME_LABELERS = ("titled", "introduced", "given", "full", "beside", "no_name")
ADDRESS_LABELERS = ("announced", "postcode", "number", "beside", "year")
#: Characters around a candidate within which another span of personal data speaks for it.
BESIDE = 60
_SCHEMA = "struct<base:array<struct<k:int,s:int,e:int>>,more:array<struct<k:int,s:int,e:int,votes:long,shape:int>>>"
_SPAN = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])
_MORE = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("votes", pa.int64()), ("shape", pa.int32())])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every @ with what can stand before it, back to the @ or the match before, and a domain after."""
    floor, at = 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        own = len(before) - len(before.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if own else None
        if domain:
            yield at - own, domain.end()
        floor = domain.end() if domain else at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start: leftmost non-overlapping matches of each kind that pass its test."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _openings(text: str) -> list[int]:
    """Ends of announcing words and assignment signs."""
    low = text.lower()
    if len(low) != len(text):  # some capitals become two characters: places would shift
        return [m.end() for m in _OPENS.finditer(text)]
    out = []
    for word in (*ANNOUNCE, "=", ":"):
        at = low.find(word)
        while at >= 0:
            out.append(at + len(word))
            at = low.find(word, at + 1)
    return out


def _led(text: str) -> set[tuple[int, int]]:
    """Tokens of any length that follow an announcing word or an assignment; the "is" between them is none. Only tokens that
    start within REACH are read, so an opening inside a long token costs nothing."""
    out, seen = set(), 0
    for end in sorted(_openings(text)):
        for a in range(max(end, seen), min(end + REACH + 1, len(text))):
            seen = a + 1
            if text[a] not in _INSIDE or (a and text[a - 1] in _INSIDE):
                continue  # no token, or the rest of a longer one
            before = text[max(0, a - 32) : a]
            announced = _ANNOUNCED.search(before)
            if not announced and not _ASSIGNED.search(before):
                continue
            m = _TOKEN.match(text, a)
            if _WORDY.search(m[0]) and not (announced and m[0].lower() == "is"):
                out.add(m.span())
    return out


def _free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether no span of the sorted, merged list `taken` overlaps a to b."""
    k = bisect_left(taken, (b, 0)) - 1
    return k < 0 or taken[k][1] <= a


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens of letters, digits, _ + / - apart from the base spans: those of SHORTEST or more with a digit, and all that
    an announcing word or an assignment leads to."""
    taken, last = _merged([(s, e) for _, s, e in base]), 0
    out = {(a, b) for a, b in _led(text) if _free(taken, a, b)}
    for m in _PART.finditer(text):
        if m.start() < last:
            continue
        before = text[last : m.start()]
        tail = len(before) - len(before.rstrip(_SIGNS))
        a, end = m.start() - tail, _OUTSIDE.search(text, m.end())
        last = end.start() if end else len(text)
        if last - a >= SHORTEST and _free(taken, a, last):
            out.add((a, last))
    return sorted(out)


def judge(text: str, a: int, b: int) -> tuple[list[int], int]:
    """The labelers' votes on a candidate (1 secret, -1 not, 0 abstain) and its features as bits."""
    span, before = text[a:b], text[max(0, a - 32) : a]
    digits = sum(c.isdigit() for c in span)
    letters = sum(c.isalpha() for c in span)
    switches = sum(x.isdigit() != y.isdigit() for x, y in zip(span, span[1:], strict=False))
    assigned, announced = bool(_ASSIGNED.search(before)), bool(_ANNOUNCED.search(before))
    low = span.lower()
    key, national = bool(_KEY.fullmatch(span) and letters), bool(_NATIONAL.fullmatch(span))
    votes = [
        1 if key else 0,
        1 if national else 0,
        1 if announced else 0,
        1 if assigned else 0,
        1 if digits >= 3 and letters >= 3 and switches >= 4 else -1 if switches <= 1 and digits and len(span) >= SHORTEST else 0,
        -1 if low.startswith(HARMLESS) or span.count("/") + span.count("-") + span.count("_") > 3 else 0,
        1 if assigned and announced else 0,
    ]
    shape = (
        3 * digits >= len(span), len(span) >= 16, letters > 0 and span.upper() == span, letters > 0 and low == span, letters > 0,
        switches >= 4, assigned, announced, text[max(0, a - 1) : a] in ('"', "'", "`"), "-" in span or "/" in span,
        key, national, digits > 0, assigned and announced,
    )
    return votes, sum(1 << k for k, x in enumerate(shape) if x)


def _near(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a span of the sorted, merged list begins or ends within BESIDE characters of a to b."""
    return not _free(spans, max(0, a - BESIDE), b + BESIDE)


def names(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, list[int], int]]:
    """(start, end, votes, features) of the candidates for names. taken: the base spans, sorted and merged."""
    found: dict[tuple[int, int], list[bool]] = {}
    low = text.lower()
    introduced = any(w in low for w in INTRODUCED)  # hardly any text has one
    for k, opening in enumerate((_TITLED, _INTRO, _GIVEN)):
        for m in opening.finditer(text) if introduced or opening is not _INTRO else ():
            if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
                continue
            full = _FULL.match(text, m.end())
            if full and _free(taken, *full.span()):
                found.setdefault(full.span(), [False] * 3)[k] = True
    out = []
    for (a, b), (titled, introduced, _) in sorted(found.items()):
        words = text[a:b].split(" ")
        given, beside, no_name = words[0] in GIVEN, _near(taken, a, b), any(w in NO_NAMES for w in words)
        votes = [int(titled), int(introduced), int(given), 1 if len(words) > 1 else 0, int(beside), -1 if no_name else 0]
        shape = (titled, introduced, given, len(words) > 1, len(words) > 2, beside, no_name)
        out.append((a, b, votes, sum(1 << k for k, x in enumerate(shape) if x)))
    return out


def addresses(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, list[int], int]]:
    """(start, end, votes, features) of the candidates for addresses."""
    out = []
    found = [*_HOUSE_FIRST.finditer(text), *_STREET_FIRST.finditer(text)]
    if any(w in text for w in _STREET_ENDS):
        found += _ONE_WORD.finditer(text)
    for m in sorted(found, key=lambda m: m.span()):
        a, b = m.span()
        if a and (text[a - 1].isalnum() or text[a - 1] in "._"):
            continue
        if not _free(taken, a, b):
            continue
        number = re.search(r"[0-9]+", m[0])[0]
        year = 1900 <= int(number) <= 2099 and m[0].startswith(number)
        announced, postcode, beside = bool(_LIVES.search(text[max(0, a - 32) : a])), bool(_POSTCODE.match(text, b)), _near(taken, a, b)
        votes = [int(announced), int(postcode), -1 if int(number) == 0 else 1, int(beside), -1 if year else 0]
        shape = (announced, postcode, beside, year, m[0][0].isdigit(), len(m[0]) > 24)
        out.append((a, b, votes, sum(1 << k for k, x in enumerate(shape) if x)))
    return out


def _scan(col: pa.Array) -> pa.Array:
    base, more = [], []
    for x in col:
        text = x.as_py() or ""
        own = base_spans(text)
        taken = _merged([(s, e) for _, s, e in own])
        judged = [(4, a, b, *judge(text, a, b)) for a, b in candidates(text, own)]
        judged += [(5, *c) for c in names(text, taken)] + [(6, *c) for c in addresses(text, taken)]
        base.append([{"k": k, "s": s, "e": e} for k, s, e in own])
        more.append([{"k": k, "s": a, "e": b, "votes": int(weak.encode(np.array([v]))[0]), "shape": f} for k, a, b, v, f in judged])
    return pa.StructArray.from_arrays([pa.array(base, pa.list_(_SPAN)), pa.array(more, pa.list_(_MORE))], ["base", "more"])


def _bits(shapes: np.ndarray) -> np.ndarray:
    return (shapes[:, None] >> np.arange(len(FEATURES))) & 1


def train(shapes: np.ndarray, soft: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression on feature bits and a constant, against soft labels, by Newton steps on weighted combinations.

    The ridge weighs as much as so many candidates, so that rare features count in large inputs, too.
    """
    x = np.column_stack([np.ones(len(shapes)), _bits(shapes)])
    w, share, ridge = np.zeros(x.shape[1]), weight / weight.sum(), ridge / weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (share * (soft - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


#: By kind: labelers, starting odds, labelers whose odds stay, share of true candidates to start from. Names and addresses are
#: candidates by their forms already, so most are true; a title is known to speak for a name, a word that is none against it.
_PRIOR = [[0.30, 0.65, 0.05], [0.03, 0.55, 0.42]]
_TITLE = [[0.001, 0.9985, 0.0005], [0.001, 0.579, 0.42]]
_NO = [[0.60, 0.3999, 0.0001], [0.002, 0.9979, 0.0001]]
MODELS = {
    4: (LABELERS, START, EXACT, 0.5),
    5: (NAME_LABELERS, np.array([_TITLE] + [_PRIOR] * 4 + [_NO]), (0, 5), 0.8),
    6: (ADDRESS_LABELERS, np.array([_PRIOR] * 4 + [_NO]), (4,), 0.9),
}


def accepted_shapes(scanned: DataFrame) -> list[int]:
    """The kinds and feature combinations (kind << 16 | features) that the trained classifiers take for spans, from counts over
    all candidates.

    At most 3**7 * 2**14 combinations of votes and features of a kind can occur, whatever the number of texts.
    """
    counts = scanned.select(F.inline("scan.more")).groupBy("k", "votes", "shape").agg(F.count(F.lit(1)).alias("n"))
    seen, out = counts.orderBy("k", "votes", "shape").collect(), []
    for kind, (labelers, start, known, share) in MODELS.items():
        own = [r for r in seen if r["k"] == kind]
        if not own:
            continue
        codes, shapes, n = (np.array([r[c] for r in own], np.int64) for c in ("votes", "shape", "n"))
        patterns, at = np.unique(codes, return_inverse=True)
        votes = weak.decode(patterns, len(labelers))
        model = weak.fit(votes, np.bincount(at, n), share=share, start=start, known=known)
        w = train(shapes, model.posterior(votes)[at], n.astype(float))
        every = np.unique(shapes)
        out += (kind << 16 | every[w[0] + _bits(every) @ w[1:] > 0]).tolist()
    return out


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans for every row."""
    scan = F.arrow_udf(_scan, _SCHEMA).asNondeterministic()
    scanned = materialize(docs.select("doc_id", scan(F.col("text")).alias("scan")))
    accepted = F.array(*[F.lit(s) for s in accepted_shapes(scanned)]).cast("array<int>")
    names = F.array(*[F.lit(k) for k in KINDS])
    count = lambda k: F.size(F.filter("scan.base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")
    more = F.filter("scan.more", lambda x: F.array_contains(accepted, F.shiftleft(x["k"], 16).bitwiseOR(x["shape"])))
    more = F.array_sort(F.transform(more, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))))
    return scanned.select(
        "doc_id",
        *[count(k) for k in range(4)],
        F.sha2(line(F.col("scan.base")), 256).alias("base_sha256"),
        line(F.concat("scan.base", more)).alias("spans"),
    )
