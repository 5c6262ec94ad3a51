"""Personal data by weak supervision.

Candidate spans are everything that could be an e-mail address, IP address (4 or
6), phone number (bare digits too), card, account or social-security number,
secret (a long token, or whatever is assigned to a word such as password or
token) or person's name (capitalised words side by side, words after a title, a
given name or a phrase such as "my name is"), and every other token with a digit.
Six labelers look at each span and vote personal (1), not (-1) or nothing (0):
the strict pattern of its kind, a checksum or plausibility test, a gazetteer
(top-level domains, issuer prefixes, country codes, key prefixes, given names),
the four words before it, marks around it, and its length in characters.  Votes
are counted over all documents; from the counts expectation-maximisation
estimates, for each kind, how often each labeler votes what on personal and other
spans, and so the probability of every pattern of votes.  The estimates are
drawn to what the labelers are meant to do, by ``strength`` times the spans of the
kind, so a kind whose spans are all personal isn't split at random.  On these
probabilities a logistic classifier of the span's shape and context is trained,
which decides every span.

Both fits work on counts of patterns, of which there is a bounded number, so
nothing that reaches the driver grows with the documents.

Defined cases: null and empty texts have no spans; a null id is carried;
repeated rows give repeated spans; texts are searched whole, and the words before
a span are whole words however long; without any span the result is empty; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import ipaddress
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .columns import col
from .decontaminate import FUNCTION_WORDS
from .storage import written

KINDS = ("EMAIL", "IP", "CARD", "PHONE", "SECRET", "PERSON", "IBAN", "SSN", "ASSIGNED", "DIGITS", "NUMBER")
OUTPUT = {"ASSIGNED": "SECRET", "DIGITS": "PHONE"}
LABELERS = ("pattern", "check", "gazetteer", "context", "marks", "size")
SHAPES = {"length": 6, "digits": 4, "before": 4, "around": 3, "joins": 4, "form": 3}
BY_KIND = ("before", "form")
STRENGTH = 1.0
CANDIDATE = re.compile(
    r"(?P<EMAIL>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<IP>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)|(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}))(?![\w:]))"
    r"|(?P<IBAN>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<SSN>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<CARD>(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w))"
    r"|(?P<PHONE>(?<![\w.(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]\d{2,5}){1,4}(?!\w)|(?<![\w.])\+\d{7,15}(?!\w))"
    r"|(?P<DIGITS>(?<![\w.,:/-])\d{7,12}(?![\w%]|[.,:/-]\d))"
    r"|(?P<SECRET>(?<![\w/+-])(?=[\w/+-]*\d)[A-Za-z0-9_/+-]{20,}={0,2}(?!\w))"
    r"|(?P<NUMBER>(?<!\w)(?=[^\W\d_]*\d)\w+(?:[.,:/-]\w+)*)"
)
KEY_WORDS = "password passwd pwd passphrase secret token key apikey auth bearer credential credentials passwort kennwort contraseña passe".split()
_KEYED = "(?:" + "|".join(KEY_WORDS) + ")"
ASSIGNED = re.compile(rf"""(?<![^\W_]){_KEYED}[\w-]*["']?(?:\s*(?:[:=]|=>)\s*|\s+is\s+)["']?(?P<a>[^\s"'<>,;]{{6,}})|(?<![^\W_]){_KEYED}\s+(?P<b>(?=\S*\d)(?=\S*[A-Za-z])[\w+/-]{{8,}})""", re.IGNORECASE)
TITLES = frozenset("mr mrs ms dr prof herr frau señor señora monsieur madame mme".split())
GIVEN_NAMES = "james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen daniel nancy matthew lisa anthony betty mark sandra donald ashley steven emily paul donna andrew michelle kevin carol brian amanda george edward ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon benjamin samuel alexander patrick jack dennis jerry alice anna bob carlos elena hans ivan juan julia laura maria marie natalia pierre sofia tom".split()
NAMING = "name is|name ist|name:|named|called|i am|i'm|signed|sincerely,?|regards,?|dear|ich heiße|ich heisse|je m'appelle|nom est|me llamo|nombre es"
NAMING_WORDS = frozenset("name named called signed sincerely regards dear heiße heisse appelle nom llamo nombre am".split())
PERSONAL_WORDS = frozenset("email e-mail mail contact phone tel telephone mobile call fax card visa mastercard credit ip host server address token key secret password passwd pwd passphrase api auth bearer name ssn iban account konto cuenta compte telefon teléfono téléphone".split())
OTHER_WORDS = frozenset("version license licence page chapter section figure table year isbn volume issue no item step line public gpl apache".split())
DOMAINS = frozenset("com org net edu gov io info biz de fr es uk eu us ca au jp cn in it nl ch at be se no dk fi pl ru br mx".split())
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91".split())
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "pk_", "xox", "eyJ", "AIza")
_MARK = re.compile(r"[\d@]|::")
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
_SMALL = frozenset(FUNCTION_WORDS)
_GIVEN_SET = frozenset(GIVEN_NAMES)
_BIG = r"[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:['’-][^\W\d_]+)*"
_ANY = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_PERSON = (
    re.compile(rf"(?<!\w)(?i:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? +(?P<v>{_BIG}(?: {_BIG}){{0,2}})"),
    re.compile(rf"(?<!\w)(?i:{NAMING}) +(?P<v>{_ANY}(?: {_ANY})?)"),
    re.compile(rf"(?<!\w)(?P<v>(?i:{'|'.join(GIVEN_NAMES)}) +{_ANY})"),
    re.compile(rf"(?<![\w'’-])(?P<v>{_BIG}(?: {_BIG}){{1,3}})"),
)


def _hashes(words: list[str]) -> np.ndarray:
    data, offsets = tb.utf8(pa.array(words))
    return np.sort(tb.span_hashes(data, offsets[:-1], offsets[1:]))


_KEY_HASHES, _NAME_HASHES = _hashes(KEY_WORDS), _hashes([*GIVEN_NAMES, *sorted(TITLES), *sorted(NAMING_WORDS)])


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban(s: str) -> bool:
    """Whether the check digits of an account number are right."""
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def entropy(s: str) -> float:
    """Bits a character, under the string's own frequencies."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _address(span: str) -> bool:
    try:
        return ipaddress.ip_address(span) is not None
    except ValueError:
        return False


def votes(kind: str, span: str, words: list[str], left: str, right: str) -> tuple[int, ...]:
    """One vote of each labeler; ``words`` are the four before in lower case, left and right are the adjacent characters."""
    digits = re.sub(r"\D", "", span)
    pattern = check = gazetteer = size = 0
    if kind == "EMAIL":
        pattern = 1 if re.fullmatch(r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}", span) or not span.isascii() else -1
        gazetteer = 1 if span.rsplit(".", 1)[1].lower() in DOMAINS else -1
        size = 1 if 6 <= len(span) <= 100 else -1
    elif kind == "IP" and ":" in span:
        check = 1 if len(re.findall("[0-9A-Fa-f]+", span)) >= 3 else -1
        pattern = 1 if check > 0 and _address(span) else -1
        size = 1 if len(span) >= 9 else -1
    elif kind == "IP":
        octets = [int(x) for x in span.split(".")]
        pattern = 1 if max(octets) <= 255 else -1
        check = -1 if octets[0] == 0 or max(octets) < 20 else 1
        size = 1 if len(span) >= 9 else 0
    elif kind == "CARD":
        pattern = 1
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits[0] in "3456" or digits[:4] >= "2221" and digits[:4] <= "2720" else 0
        size = 1 if 15 <= len(digits) <= 16 else 0
    elif kind == "PHONE":
        pattern = 1 if 7 <= len(digits) <= 15 and (span[0] in "+(" or len(re.findall(r"\d+", span)) >= 3) else -1
        check = 1 if 10 <= len(digits) <= 13 else -1 if len(digits) < 7 else 0
        m = re.match(r"\+(\d{1,3}?)(?=\D)", span)
        gazetteer = 0 if not m else 1 if m[1] in COUNTRY_CODES else -1
        size = 1 if len(span) >= 10 else -1
    elif kind == "SECRET":
        pattern = 1 if re.fullmatch(r"[0-9a-fA-F]{32,}|[A-Za-z0-9_/+-]{24,}={0,2}", span) else 0
        check = 1 if entropy(span) >= 3 else -1
        gazetteer = 1 if span.startswith(KEY_PREFIXES) else 0
        size = 1 if len(span) in (32, 40, 64) else 0
    elif kind == "ASSIGNED":
        classes = sum(bool(re.search(p, span)) for p in ("[a-z]", "[A-Z]", r"\d", r"[^\w]"))
        pattern = 1 if classes >= 2 else -1
        check = 1 if entropy(span) >= 2.5 else -1
        gazetteer = 1 if span.startswith(KEY_PREFIXES) else 0
        size = 1 if len(span) >= 8 else 0
    elif kind == "PERSON":
        parts = span.split()
        pattern = 0 if all(w[:1].isupper() for w in parts) else -1
        check = -1 if any(w.lower() in _SMALL for w in parts) or len(parts) == 1 and not parts[0][:1].isupper() else 0
        gazetteer = 1 if parts[0].lower() in _GIVEN_SET else 0
        size = 0 if 3 <= len(span) <= 40 else -1
    elif kind == "IBAN":
        pattern = 1 if 15 <= len(span.replace(" ", "")) <= 34 else -1
        check = 1 if iban(span) else -1
        size = 1
    elif kind == "SSN":
        pattern = 1
        check = -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1
    elif kind == "DIGITS":
        check = 1 if 10 <= len(digits) <= 12 else 0
        gazetteer = -1 if re.match(r"(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:[0-2]\d|3[01])\Z", digits) else 0
    else:
        pattern = -1
        check = -1
        size = -1 if len(span) < 8 else 0
    if kind == "PERSON":
        context = 1 if TITLES.union(NAMING_WORDS).intersection(words) else 0 if gazetteer and not pattern else -1
    else:
        context = 1 if PERSONAL_WORDS.intersection(words) else -1 if OTHER_WORDS.intersection(words) or kind == "DIGITS" else 0
    marks = 1 if left in "\"'=<:" and right in "\"'>,;.!# " and left else -1 if right == "%" or left in "$€£#" and left else 0
    return pattern, check, gazetteer, context, marks, size


def shape(kind: str, span: str, words: list[str], left: str, voted: tuple[int, ...]) -> tuple[int, ...]:
    """Small numbers: length, share of digits, context before, mark before, marks within, and what test and list say."""
    n = len(span)
    share = sum(c.isdigit() for c in span) / n
    telling = TITLES | NAMING_WORDS if kind == "PERSON" else PERSONAL_WORDS
    return (
        0 if n < 4 else 1 if n < 9 else 2 if n < 14 else 3 if n < 18 else 4 if n < 32 else 5,
        0 if share == 0 else 1 if share < 0.5 else 2 if share < 1 else 3,
        1 if telling.intersection(words) else 2 if OTHER_WORDS.intersection(words) else 3 if not words else 0,
        1 if left and left in "\"'=<:" else 2 if left and left in "$€£#" else 0,
        3 if "@" in span else 2 if "(" in span or "+" in span else 1 if re.search(r"[ .,:/-]", span) else 0,
        min(2, max(0, (voted[1] or voted[2] or (voted[0] if kind == "PERSON" and voted[0] < 0 else 0)) + 1)),
    )


def spans(text: str, keyed: bool = True) -> Iterator[tuple[int, int, str]]:
    """Candidate spans of one text, without names; what is assigned to a key word (if there is any) replaces plain numbers in it.

    No candidate goes over a line's end, so only lines with a digit, an @ or two colons are searched.
    """
    found, at = [], 0
    for line in text.split("\n"):
        if _MARK.search(line):
            found += [(at + m.start(), at + m.end(), m.lastgroup or "NUMBER") for m in CANDIDATE.finditer(line)]
        at += len(line) + 1
    given = []
    for m in ASSIGNED.finditer(text) if keyed else ():
        group = "a" if m["a"] else "b"
        start, end = m.start(group), m.start(group) + len(m[group].rstrip(".!?)"))
        over = [x for x in found if x[0] < end and start < x[1]]
        if end - start >= 6 and all(k in ("NUMBER", "DIGITS", "PHONE") for _, _, k in over):
            given.append((start, end, "ASSIGNED"))
    yield from sorted([x for x in found if not any(x[0] < b and a < x[1] for a, b, _ in given)] + given) if given else found


def people(text: str) -> Iterator[tuple[int, int, str]]:
    """Candidate names, the longest where several overlap; function words at their ends are cut off."""
    found = set()
    for p in _PERSON:
        at = 0
        while m := p.search(text, at):
            at = m.start("v") + 1 if p is _PERSON[1] else m.end()
            start, words = m.start("v"), m["v"].split(" ")
            while words and (words[0].lower() in _SMALL or words[0].rstrip(".").lower() in TITLES):
                start += len(words[0]) + 1
                words = words[1:]
                while words and not words[0]:
                    start, words = start + 1, words[1:]
            while words and (not words[-1] or words[-1].lower() in _SMALL):
                words.pop()
            if words and (len(words) > 1 or p is not _PERSON[3] and p is not _PERSON[2]):
                found.add((start, start + len(" ".join(words))))
    end = -1
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= end:
            yield a, b, "PERSON"
            end = b


def words_before(text: str, start: int, most: int = 4) -> list[str]:
    """The last whole words before a place, in lower case."""
    size = 64
    while True:
        low = max(0, start - size)
        found = _WORDS.findall(text[low:start])
        if low == 0 or len(found) > most + 1:
            return [w.lower() for w in found[-most:]]
        size *= 2
        if size > 1 << 16 and not re.search(r"[^\W\d_]", text[low:start]):
            return []  # only marks and digits


def _described(text: str, start: int, end: int, kind: str) -> tuple:
    left, right = text[max(0, start - 1) : start], text[end : end + 1]
    if left == " ":
        left = text[max(0, start - 2) : start - 1] if text[max(0, start - 2) : start - 1] in "=:" else ""
    words, span = words_before(text, start), text[start:end]
    voted = votes(kind, span, words, left, right or " ")
    return (KINDS.index(kind), *voted, *shape(kind, span, words, left, voted))


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["kind", *LABELERS, *SHAPES]
    for batch in batches:
        column = batch.column(1)
        data, offsets = tb.utf8(column)
        if not len(data):
            continue
        numeric: set[int] = set()
        keyed: set[int] = set()
        named: set[int] = set()
        for i, j in tb.chunks(offsets):
            part = data[offsets[i] : offsets[j]]
            mark = np.flatnonzero((part >= 48) & (part <= 57) | (part == 64)) + offsets[i]
            numeric.update(np.unique(np.searchsorted(offsets, mark, "right") - 1).tolist())
            colons = np.flatnonzero((part[1:] == 58) & (part[:-1] == 58)) + offsets[i]
            numeric.update(np.unique(np.searchsorted(offsets, colons, "right") - 1).tolist())
            low = tb.fold(part)
            start, end, doc = tb.word_spans(low, offsets[i : j + 1] - offsets[i])
            if not len(start):
                continue
            h = tb.span_hashes(low, start, end)
            for known, out in ((_KEY_HASHES, keyed), (_NAME_HASHES, named)):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                out.update((np.unique(doc[known[at] == h]) + i).tolist())
            second = np.minimum(start + 1, len(part) - 1)
            capital = ((part[start] >= 65) & (part[start] <= 90)) | ((part[start] == 0xC3) & (low[second] != part[second]))
            pair = capital[1:] & capital[:-1] & (start[1:] - end[:-1] == 1) & (part[end[:-1].clip(max=len(part) - 1)] == 32)
            named.update((np.unique(doc[1:][pair]) + i).tolist())
        rows: list[int] = []
        out: list[tuple] = []
        for k in sorted(numeric | keyed | named):
            text = column[k].as_py()
            found = [*(spans(text, k in keyed) if k in numeric or k in keyed else ()), *(people(text) if k in named else ())]
            for start, end, kind in found:
                rows.append(k)
                out.append((start, end, *_described(text, start, end, kind)))
        if rows:
            table = np.array(out, np.int64)
            arrays = [batch.column(0).take(pa.array(rows)), *(pa.array(table[:, c]) for c in (0, 1)), *(pa.array(table[:, c].astype(np.int8)) for c in range(2, table.shape[1]))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "start", "end", *names])


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every candidate span with votes and shape."""
    kept = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).where("text is not null")
    fields = [T.StructField("id", kept.schema["id"].dataType), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    return kept.mapInArrow(_emit, T.StructType(fields + [T.StructField(x, T.ByteType()) for x in ("kind", *LABELERS, *SHAPES)]))


_FREE = [KINDS.index(x) for x in ("PERSON", "DIGITS", "ASSIGNED")]  # kinds without a strict pattern
#: How often a labeler that speaks is meant to be right; of names, a test that fails is all but sure.
RIGHT = {"PERSON": (0.6, 0.97, 0.8, 0.9, 0.8, 0.8)}
MEANT = np.array([[[[r, 0, 1 - r], [1 - r, 0, r]] for r in RIGHT.get(k, (0.8,) * 6)] for k in KINDS])  # kind, labeler, other and personal, vote


def first_guess(kind: np.ndarray, pattern: np.ndarray) -> np.ndarray:
    """Probabilities to start from: the votes' sum; a strict pattern counts three times where a kind has one, test, list and context of names twice."""
    weight = np.ones(pattern.shape)
    weight[~np.isin(kind, _FREE), 0] = 3
    weight[kind == KINDS.index("PERSON"), 1:4] = 2
    bias = np.where(kind == KINDS.index("PERSON"), -1.0, np.where(kind == KINDS.index("DIGITS"), -0.5, 0.0))
    return 1 / (1 + np.exp(-(1.5 * (weight * pattern).sum(axis=1) + bias)))


def estimate(kind: np.ndarray, pattern: np.ndarray, count: np.ndarray, strength: float = STRENGTH, rounds: int = 200) -> tuple[np.ndarray, dict[int, np.ndarray], dict[int, float]]:
    """Probability that each pattern of votes is personal; of each kind the reliabilities [labeler, personal, vote + 1] and the prior.

    Two classes a kind, votes independent given the class; reliabilities are
    shares of the votes that aren't 0.
    """
    p, thetas, priors = first_guess(kind, pattern), {}, {}
    for x in np.unique(kind).tolist():
        own = kind == x
        p[own], thetas[x], priors[x] = _estimate(pattern[own], count[own], p[own], MEANT[x], strength, rounds)
    return p, thetas, priors


def _estimate(pattern: np.ndarray, count: np.ndarray, p: np.ndarray, meant: np.ndarray, strength: float, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    n, m = pattern.shape
    theta, prior = np.full((m, 2, 3), 1 / 3), 0.5
    for _ in range(rounds):
        theta = meant * (3 + strength * count.sum())
        for v in range(3):
            hit = pattern == v - 1
            theta[:, 1, v] += (hit * (p * count)[:, None]).sum(axis=0)
            theta[:, 0, v] += (hit * ((1 - p) * count)[:, None]).sum(axis=0)
        theta /= theta[:, :, [0, 2]].sum(axis=2, keepdims=True)
        prior = ((p * count).sum() + 1 + strength * count.sum() / 2) / (count.sum() * (1 + strength) + 2)
        score = np.full(n, math.log(prior / (1 - prior)))
        for k in range(m):  # a labeler that says nothing tells nothing
            score += np.where(pattern[:, k] == 0, 0.0, np.log(theta[k, 1, pattern[:, k] + 1] / theta[k, 0, pattern[:, k] + 1]))
        new = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        done = np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    return p, theta, prior


def _features() -> list[tuple[str, int]]:
    """Names and sizes of the classifier's one-hot features; some are crossed with the kind."""
    return [("kind", len(KINDS)), *((x, n * (len(KINDS) if x in BY_KIND else 1)) for x, n in SHAPES.items())]


def design(shapes: np.ndarray) -> np.ndarray:
    """One-hot columns of kind and shape, and a constant."""
    parts = []
    for k, (name, size) in enumerate(_features()):
        at = shapes[:, 0] * SHAPES[name] + shapes[:, k] if name in BY_KIND else shapes[:, k]
        parts.append(np.eye(size)[at])
    return np.concatenate([*parts, np.ones((len(shapes), 1))], axis=1)


def fit(shapes: np.ndarray, target: np.ndarray, count: np.ndarray, ridge: float = 0.1, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic classifier of soft targets, by Newton's method."""
    x = design(shapes)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (count * (p - target)) + ridge * w
        h = (x * (count * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, strength: float = STRENGTH) -> DataFrame:
    """Columns doc_id, start, end (characters from 0), kind, probability, one row for each personal span."""
    found = written(candidates(docs, id_col, text_col), "spans")
    names = ["kind", *LABELERS, *SHAPES]
    counts = found.groupBy(*names).count().orderBy(*names).toPandas()  # bounded by the patterns there are
    table, n = counts[names].to_numpy(np.int64), counts["count"].to_numpy(float)
    p, _, _ = estimate(table[:, 0], table[:, 1 : 1 + len(LABELERS)], n, strength)
    w = fit(np.concatenate([table[:, :1], table[:, 1 + len(LABELERS) :]], axis=1), p, n)
    score, at = F.lit(float(w[-1])), 0
    for name, size in _features():
        place = F.col("kind").cast("int") * SHAPES[name] + F.col(name).cast("int") if name in BY_KIND else F.col(name).cast("int")
        score = score + F.element_at(F.array(*(F.lit(float(v)) for v in w[at : at + size])), place + 1)
        at += size
    probability = F.lit(1.0) / (F.lit(1.0) + F.exp(-score))
    kind = F.element_at(F.array(*(F.lit(OUTPUT.get(k, k)) for k in KINDS)), F.col("kind").cast("int") + 1)
    return found.withColumn("probability", probability).where(F.col("probability") >= least).select(F.col("id").alias("doc_id"), "start", "end", kind.alias("kind"), "probability")
