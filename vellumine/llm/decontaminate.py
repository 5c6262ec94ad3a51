"""Benchmark decontamination by canonical templates.

Numbers, names and units of a text become typed placeholders.  A number is a
word that begins with a digit or is a number word (digits joined by one of
``.,:/-`` and number words side by side are one number); digits and a unit
written together are two words.  A unit is a word of a fixed list for English,
French, German and Spanish; some short ones count only after a number.  A name
is a capitalised word inside a sentence that is no function word (names side by
side are one); a capitalised word that opens a sentence is read both ways, as a
literal and as a name, so no list of names is needed.  Windows of ``window``
template tokens, two or more of them literal (one, if all tokens of the item
must be covered and none of the window is a name), are hashed, in both readings
where they differ, and so are windows of ``window`` words as they are
written, whatever their kinds; the windows of documents that pass a bitmap of
the benchmark's windows are joined with those by hash.  Matches with the same
distance between document and item position form an alignment; it counts if its
slots are consistent: each value of the item stands for one value in the
document (two values may become equal).  Of an alignment that contradicts itself
only the longest consistent runs of windows count, and only those of twice
``least`` tokens, as parts of a long item with some values changed; its verbatim
runs count as words.  A document leaks an item when the consistent
alignments cover ``least`` of the item's tokens (all, if it has fewer).  So
items with other numbers, names or units are found as well as verbatim ones.
Windows of words cover words, of which ``least`` (all, if the item has fewer) are
needed too; so verbatim items are found however short they are, however many
numbers and names they have and wherever their sentences begin.  With other values
an item needs ``TEMPLATE_SHORTEST`` tokens, and is not found where a window must be
covered that has fewer literals, or that holds one opening word in each reading.
In texts that capitalise nouns, nouns are placeholders too.

The bitmap has about sixteen bits a window of the benchmark, within bounds; it
only saves work.

Defined cases: null, empty and blank texts match nothing; an item shorter than a
window is matched as a whole; documents with a null id are matched under that
null; rows that repeat id and text are one document; repeated items each match;
empty tables give no matches; other columns, whatever their names, are carried
or ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .columns import col, free, named

WINDOW, LEAST, TEMPLATE_SHORTEST = 8, 13, 5
MAP_BITS = (22, 29)
_TENS = "zwanzig dreißig dreissig vierzig fünfzig sechzig siebzig achtzig neunzig".split()
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million millions billion billions dozen half twice "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt vingts trente quarante cinquante soixante mille milliard milliards demi "
    "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn hundert tausend millionen milliarde milliarden dutzend halb "
    "cero dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento cientos mil millón millones media medio"
).split() + _TENS + [u + "und" + t for u in "ein zwei drei vier fünf sechs sieben acht neun".split() for t in _TENS]
UNITS = (
    "mm cm km kg ml mg kmh mph inch inches foot feet yard yards mile miles gram grams kilogram kilograms kilo kilos ton tons tonne tonnes pound pounds ounce ounces litre litres liter liters gallon gallons pint pints quart quarts bushel bushels acre acres hectare hectares second seconds minute minutes hour hours day days week weeks month months year years decade decades century centuries dollar dollars dólar dólares cent cents euro euros usd eur gbp percent degree degrees celsius fahrenheit kelvin watt watts volt volts amp amps joule joules newton newtons metre metres meter meters centimetre centimetres centimeter centimeters kilometre kilometres kilometer kilometers byte bytes kilobyte kilobytes megabyte megabytes gigabyte gigabytes hertz kwh knots calorie calories "
    "jour jours heure heures seconde secondes semaine semaines mois année années mètre mètres kilomètre kilomètres centimètre centimètres gramme grammes kilogramme kilogrammes centime centimes pourcent livre livres "
    "tag tage tagen stunde stunden minuten sekunde sekunden woche wochen monat monate monaten jahr jahre jahren gramm kilogramm prozent pfund zentimeter tonnen "
    "día días hora horas minuto minutos segundo segundos semanas meses año años metro metros kilómetro kilómetros centímetro centímetros gramo gramos kilogramo kilogramos litro litros tonelada toneladas céntimo céntimos centavo centavos peso pesos libra libras grado grados"
).split()
UNITS_AFTER_NUMBERS = "m g l h s t w v a k ms ns hz khz mhz ghz gb mb kb tb lb lbs oz ft yd mi pa kpa bar bars an ans mes min sec hr hrs hz kw mw cv ha nm pt".split()
FUNCTION_WORDS = (
    "a an the this that these those i you he she it we they my your his her its our their who whom whose which what when where why how if then than there here in on at by for from to of with without and or but so as is are was were be been do does did has have had can could will would shall should may might must not no yes all each every some any both after before once while during since until because although though let given suppose assume find compute calculate show prove "
    "le la les l un une des du de d et ou mais donc or ni car ce cet cette ces il elle on nous vous ils elles je tu mon ma mes son sa ses leur leurs notre votre qui que quoi dont où quand comment pourquoi combien si dans sur sous par pour avec sans en au aux est sont était a ont chaque tout tous toute toutes "
    "der die das den dem des ein eine einen einem einer eines und oder aber denn wenn als wie wo wer was wann warum ich du er sie es wir ihr mein dein sein unser euer in im an am auf aus bei mit nach von vom zu zum zur für durch über unter vor ist sind war waren hat haben hatte kann nicht kein keine jede jeder jedes alle "
    "el los las una unos unas y o pero porque si cuando donde como quien que cual cuanto cuantos en con sin por para desde hasta entre sobre es son era fue ha han hay no se su sus mi tu nuestro ella ellos ellas yo él cada todo todos toda todas al del"
).split()
_NUMBER, _NAME, _UNIT, _AFTER, _FUNCTION = 1, 2, 3, 4, 5
_PLACE = tb.mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_WORDS = np.uint64(0xA24BAED4963EE407)
_QUIET = np.zeros(256, bool)
_QUIET[[32, 44, 45, 39, 9]] = True
_JOINS = np.zeros(256, bool)
_JOINS[[44, 45, 46, 47, 58]] = True


def _listed() -> tuple[np.ndarray, np.ndarray]:
    kinds = {w: k for k, x in ((_FUNCTION, FUNCTION_WORDS), (_AFTER, UNITS_AFTER_NUMBERS), (_UNIT, UNITS), (_NUMBER, NUMBER_WORDS)) for w in x}
    data, offsets = tb.utf8(pa.array(kinds))
    h = tb.span_hashes(data, offsets[:-1], offsets[1:])
    order = np.argsort(h)
    return h[order], np.array(list(kinds.values()), np.int8)[order]


_HASHES, _KINDS = _listed()
_HINT = np.zeros(1 << 16, bool)
_HINT[(_HASHES & np.uint64(0xFFFF)).astype(np.int64)] = True


def _kinds_of(h: np.ndarray) -> np.ndarray:
    """The listed kind of each word hash, or 0."""
    kind = np.zeros(len(h), np.int8)
    maybe = np.flatnonzero(_HINT[(h & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(_HASHES, h[maybe]), len(_HASHES) - 1)
    hit = _HASHES[at] == h[maybe]
    kind[maybe[hit]] = _KINDS[at[hit]]
    return kind


def _split(low: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words such as 60km cut between digits and unit."""
    digit = (low >= 48) & (low <= 57)
    mixed = np.flatnonzero(digit[start] & ~digit[end - 1])
    if not len(mixed):
        return start, end, doc
    other = np.flatnonzero(~digit)
    middle = other[np.searchsorted(other, start[mixed])]
    unit = np.isin(_kinds_of(tb.span_hashes(low, middle, end[mixed])), (_UNIT, _AFTER))
    mixed, middle = mixed[unit], middle[unit]
    new_end = end.copy()
    new_end[mixed] = middle
    return np.insert(start, mixed + 1, middle), np.insert(new_end, mixed + 1, end[mixed]), np.insert(doc, mixed + 1, doc[mixed])


def template(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each template token the text number, kind (0: literal) and code in both readings, and value; text number and hash of each word.

    The readings differ in capitalised words that open sentences: literals in the first, names in the second.
    """
    low = tb.fold(data)
    start, end, doc = tb.word_spans(low, offsets)
    if not len(start):
        z = np.zeros(0, np.uint64)
        return doc, np.zeros(0, np.int8), z, np.zeros(0, np.int8), z, z, doc, z
    start, end, doc = _split(low, start, end, doc)
    n = len(start)
    h = tb.span_hashes(low, start, end)
    loud = np.concatenate([[0], np.cumsum(~_QUIET[data], dtype=np.int32)])
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    before = np.concatenate([[0], end[:-1]])
    opens = first | (loud[start] > loud[before])
    gap = start - before
    end_of_data = len(data) - 1

    def small(i: np.ndarray) -> np.ndarray:  # the character at i is in the word and not a capital
        j, k = np.minimum(i, end_of_data), np.minimum(i + 1, end_of_data)
        return (i < end) & ((data[j] >= 97) & (data[j] <= 122) | (data[j] >= 128) & (low[k] == data[k]))

    a = data[start]
    ascii_name = (a >= 65) & (a <= 90) & small(start + 1)
    second = np.minimum(start + 1, end_of_data)
    latin_name = (a == 0xC3) & (low[second] != data[second]) & small(start + 2)
    kind = _kinds_of(h)
    number = (a >= 48) & (a <= 57)
    kind[number] = _NUMBER
    spelled = (kind == _NUMBER) & ~number
    after = np.concatenate([[False], kind[:-1] == _NUMBER]) & ~first & (gap <= 1)
    kind[kind == _AFTER] = np.where(after[kind == _AFTER], _UNIT, 0)
    capital = (ascii_name | latin_name) & (kind == 0)
    kind[kind == _FUNCTION] = 0
    kind[capital] = _NAME
    joiner = data[np.maximum(start - 1, 0)]
    same = np.concatenate([[False], kind[1:] == kind[:-1]]) & ~first & (gap == 1)
    joined = same & ((kind == _NUMBER) & (_JOINS[joiner] | spelled & (joiner == 32)) | (kind == _NAME) & (joiner == 32))
    token = np.flatnonzero(~joined)
    size = np.diff(np.append(token, n))
    place = np.arange(n) - np.repeat(token, size)
    value = np.add.reduceat(tb.mix(h + place.astype(np.uint64)), token) + kind[token].astype(np.uint64)
    named_ = kind[token]
    literal = np.where(capital[token] & opens[token] & (size == 1), 0, named_).astype(np.int8)
    return doc[token], literal, np.where(literal == 0, h[token], _PLACE[literal]), named_, np.where(named_ == 0, h[token], _PLACE[named_]), value, doc, h


def windows(doc: np.ndarray, kind: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, hash and number of literals of each window within one text that has any."""
    n = len(code)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = tb.mix(code + np.uint64(size))
    total = h[: n - size + 1].copy()
    for k in range(1, size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : n - size + 1 + k]
    literal = np.concatenate([[0], np.cumsum(kind == 0)])
    literal = literal[size:] - literal[:-size]
    at = np.flatnonzero((doc[size - 1 :] == doc[: n - size + 1]) & (literal > 0))
    return at, tb.mix(total[at]), literal[at]


def _emit(sizes: list[int], bitmap: np.ndarray | None, keys: int, as_items: bool, least: int = LEAST):
    """Windows of template tokens, and of -size words for negative sizes."""
    map_bits = 0 if bitmap is None else int(bitmap.size * 8).bit_length() - 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.utf8(batch.column(keys))
            for i, j in tb.chunks(offsets):
                tokens, kinds, codes, kinds2, codes2, value, words, hashes = template(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n_tokens = np.bincount(tokens, minlength=j - i)
                differs = np.concatenate([[0], np.cumsum(kinds != kinds2)])
                streams = [(True, tokens, kinds, codes, False), (True, tokens, kinds2, codes2, True), (False, words, np.zeros(len(words), np.int8), hashes ^ _WORDS, False)]
                for of_tokens, doc, kind, code, other in streams:
                    first, slot, length = np.searchsorted(doc, doc), np.flatnonzero(kind), np.bincount(doc, minlength=j - i)
                    for signed in sizes:
                        if (signed > 0) != of_tokens:
                            continue
                        size = abs(signed)
                        at, h, literal = windows(doc, kind, code, size)
                        if as_items:  # a window as long as the item, or the usual length
                            n = length[doc[at]]
                            names = np.concatenate([[0], np.cumsum(kind == _NAME)])
                            ok = ((n == size) | (size == WINDOW)) & ((literal >= min(2, size)) | (n <= least) & (names[at + size] == names[at]))
                        else:
                            bit = (h >> np.uint64(64 - map_bits)).astype(np.int64)
                            ok = (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                        if other:
                            ok &= differs[at + size] > differs[at]
                        at, h = at[ok], h[ok]
                        if not len(at):
                            continue
                        lo, hi = np.searchsorted(slot, at), np.searchsorted(slot, at + size)
                        count = hi - lo
                        pick = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
                        slots = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(value[slot[pick]].view(np.int64)))
                        rows = pa.array(doc[at] + i)
                        out = [batch.column(k).take(rows) for k in range(keys)] + [pa.array((at - first[at]).astype(np.int32)), pa.array(np.full(len(at), signed, np.int32)), pa.array(n_tokens[doc[at]].astype(np.int32)), pa.array(length[doc[at]].astype(np.int32)), pa.array(h.view(np.int64)), slots]
                        yield pa.RecordBatch.from_arrays(out, [*batch.schema.names[:keys], "at", "size", "tokens", "length", "hash", "slots"])

    return emit


def consistent_runs(windows: list, size: int, least: int) -> list[int]:
    """Positions of the windows in maximal runs without contradiction that cover ``least`` tokens; windows: (q, pairs)."""
    windows = sorted(windows, key=lambda w: w[0])
    kept: set[int] = set()
    held: dict[int, Counter] = {}
    lo, clashes = 0, 0

    def keep(hi: int) -> None:
        q = [w[0] for w in windows[lo:hi]]
        if q and size + sum(min(y - x, size) for x, y in zip(q, q[1:], strict=False)) >= least:
            kept.update(q)

    for hi, (_, pairs) in enumerate(windows):
        new = [(a, b) for a, b in pairs if a not in held or b not in held[a] or len(held[a]) > 1]
        if any(a in held for a, _ in new):
            keep(hi)
        for a, b in pairs:
            c = held.setdefault(a, Counter())
            clashes += b not in c and len(c) > 0
            c[b] += 1
        while clashes:
            for a, b in windows[lo][1]:
                c = held[a]
                c[b] -= 1
                if not c[b]:
                    del c[b]
                    clashes -= len(c) > 0
                if not c:
                    del held[a]
            lo += 1
    keep(len(windows))
    return sorted(kept)


def _tail(*fields: T.StructField) -> T.StructType:
    ints = [T.StructField(x, T.IntegerType()) for x in ("at", "size", "tokens", "length")]
    return T.StructType([*fields, *ints, T.StructField("hash", T.LongType()), T.StructField("slots", T.ArrayType(T.LongType()))])


def _bits_of(key: tuple, table: pa.Table) -> pa.Table:
    bit = table["bit"].to_numpy() & ((1 << 18) - 1)
    part = np.zeros(1 << 15, np.uint8)
    np.bitwise_or.at(part, bit >> 3, np.left_shift(1, bit & 7).astype(np.uint8))
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([part.tobytes()], pa.binary())})


def bitmap_of(items: DataFrame) -> np.ndarray:
    """A bit for the first bits of each window hash; the parts are made in tasks, 2^29 bits (64 MB) come to the driver at most."""
    bits = min(max(math.ceil(math.log2(16 * max(1, items.count()))), MAP_BITS[0]), MAP_BITS[1])
    out = np.zeros(1 << (bits - 3), np.uint8)
    keyed = items.select(F.shiftrightunsigned("hash", 64 - bits).alias("bit")).withColumn("part", F.shiftright("bit", 18).cast("int"))
    for r in keyed.groupBy("part").applyInArrow(_bits_of, "part int, data binary").toLocalIterator():
        out[r.part << 15 : (r.part + 1) << 15] = np.frombuffer(r.data, np.uint8)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, shortest: int = 1) -> DataFrame:
    """Columns doc_id, t (hash of the text), item_id, covered, item_tokens, verbatim, one row per leak.

    Items of fewer than ``shortest`` words are not searched.
    """
    from .storage import written

    items = benchmark.select(col(item_col).alias("item"), col(item_text_col).cast("string").alias("text"))
    sizes = list(range(TEMPLATE_SHORTEST, WINDOW + 1)) + [-k for k in range(shortest, WINDOW + 1)]
    items = written(items.mapInArrow(_emit(sizes, None, 1, True, least), _tail(T.StructField("item", items.schema["item"].dataType))), "items")
    there = sorted(r[0] for r in items.select("size").distinct().collect())
    text = col(text_col).cast("string")
    keyed = docs.select(col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text")).where("text is not null")
    found = keyed.mapInArrow(_emit(there, bitmap_of(items), 2, False), _tail(T.StructField("id", keyed.schema["id"].dataType), T.StructField("t", T.LongType())))
    return matched(found, items, least)


def matched(found: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """Leaks from the windows of documents and of items."""
    i = items.select("item", F.col("at").alias("q"), F.col("tokens").alias("item_tokens"), "length", "size", "hash", F.col("slots").alias("item_slots"))
    d = found.select("id", "t", F.col("at").alias("p"), "size", "hash", "slots")
    pairs = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    joined = d.join(i, ["hash", "size"]).select("id", "t", "item", "item_tokens", "length", "size", "q", (F.col("p") - F.col("q")).alias("shift"), pairs.alias("pairs"))
    line = joined.groupBy("id", "t", "item", "item_tokens", "length", "size", "shift").agg(F.collect_set(F.struct("q", "pairs")).alias("windows"))
    line = line.withColumn("slots", F.array_distinct(F.flatten(F.col("windows.pairs"))))
    agrees = F.size(F.array_distinct(F.transform("slots", lambda x: x["a"]))) == F.size("slots")
    runs = F.udf(lambda windows, size: windows and consistent_runs(windows, abs(size), 2 * least), T.ArrayType(T.IntegerType()))
    long = F.size("windows") * F.abs("size") >= 2 * least
    line = line.withColumn("agrees", agrees).withColumn("runs", runs(F.when(~agrees & long, F.col("windows")), "size"))
    sound = line.withColumn("qs", F.when(F.col("agrees"), F.col("windows.q")).otherwise(F.col("runs"))).where(F.size("qs") > 0)
    sound = sound.withColumn("verbatim", F.col("agrees") & F.forall("slots", lambda x: x["a"] == x["b"]))
    whole = sound.groupBy("id", "t", "item", "item_tokens", "length", "size").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("qs")))).alias("q"), F.min("verbatim").alias("verbatim"))
    gaps = F.aggregate(F.zip_with(F.slice("q", 2, F.size("q")), F.slice("q", 1, F.greatest(F.size("q") - 1, F.lit(0))), lambda x, y: F.least(x - y, F.abs("size"))), F.lit(0), lambda s, x: s + x)
    covered = whole.select("id", "t", "item", "item_tokens", "length", "verbatim", (gaps + F.abs("size")).alias("covered")).where(F.col("covered") >= F.least(F.lit(least), "length"))
    best = covered.groupBy("id", "t", "item", "item_tokens").agg(F.max(F.least("covered", "item_tokens")).alias("covered"), F.max("verbatim").alias("verbatim"))
    return best.select(F.col("id").alias("doc_id"), "t", F.col("item").alias("item_id"), "covered", "item_tokens", "verbatim")


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without those that leak an item; other rows and all columns stay."""
    key, bad_id, bad_t = free(docs.columns, "__hash", "__id", "__t")
    bad = leaks(docs, benchmark, id_col, text_col, item_col, item_text_col).select(F.col("doc_id").alias(bad_id), F.col("t").alias(bad_t)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(col(text_col).cast("string")))
    return keyed.join(bad, col(id_col).eqNullSafe(col(bad_id)) & (col(key) == col(bad_t)), "left_anti").select(*named(docs))
