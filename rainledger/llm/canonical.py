"""Freely typed values mapped to the closest entry of a reference list: a trie under a Levenshtein automaton."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainledger.storage import Workspace

#: Entries that are sent to the workers at once; a longer list is searched part by part.
MOST_ENTRIES = 200_000
#: Resolved values that a worker keeps.
MEMO = 300_000
NONE = "-"

# Letters that look alike, words around a name, abbreviations of name parts.
_LOOKALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "ѡ": "w",
    "А": "A", "Е": "E", "О": "O", "Р": "P", "С": "C", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S", "К": "K", "М": "M", "Т": "T", "В": "B", "Н": "H",
    "α": "a", "ο": "o", "ε": "e", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "υ": "u", "Α": "A", "Ο": "O", "Ε": "E", "Ρ": "P", "Ι": "I", "Κ": "K", "Ν": "N", "Τ": "T", "Β": "B", "Η": "H", "Μ": "M", "Ζ": "Z",
    "ı": "i", "ł": "l", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d",
}
_DIGITS = {"0": "o", "1": "l", "3": "e", "5": "s"}
_BEFORE = {"omgeving", "nabij", "regio", "rond", "rondom", "bij", "in", "te", "gemeente", "near", "raum", "around", "region", "ruim", "heel", "stadje", "dorp", "provincie", "bei", "pres", "bij", "area", "the", "buurt", "van", "town", "city", "commune", "stadt", "kreis", "environs", "gebied", "district"}
_AFTER = {"nederland", "nl", "netherlands", "niederlande", "area", "eo", "omgeving", "omstreken", "en", "e", "o", "regio", "holland", "gemeente", "region", "and", "surroundings", "umgebung", "und", "environs", "et"}
_PARTS = {"n": "noord", "nrd": "noord", "no": "noord", "z": "zuid", "zd": "zuid", "zui": "zuid", "o": "oost", "ost": "oost", "w": "west", "wst": "west", "m": "midden", "mid": "midden", "midd": "midden", "nw": "nieuw", "nwe": "nieuw", "nieuwe": "nieuw", "st": "sint", "snt": "sint", "t": "het", "a": "aan", "b": "bij", "d": "de", "od": "oud", "oude": "oud"}
_ARTICLES = {"het", "t", "de"}
_AMID = {"gemeente", "regio", "provincie", "gebied", "district"}
_SIDES = {"noord", "oost", "zuid", "west", "midden"}

_DAMAGED = re.compile("[\u0080-\u00ff\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u2022\u2026\u2030\u2039\u203a\u20ac\u2122]{2,}")
_SPLIT = re.compile(r"[,;()/\[\]|]|\s[-–—]\s")
_TOKEN = re.compile(r"[^\W_]+")


def _repair(value: str) -> str:
    """Runs of signs that are UTF-8 read as a Western code page become what they were."""

    def fix(m: re.Match) -> str:
        for code in ("cp1252", "latin-1"):
            try:
                return m.group().encode(code).decode("utf-8")
            except UnicodeError:
                pass
        return m.group()

    return value if value.isascii() else _DAMAGED.sub(fix, value)


def tokens_of(value: str) -> list[str]:
    """Plain lower-case tokens: look-alikes, accents, invisible signs and digits for letters are undone."""
    value = unicodedata.normalize("NFKC", "".join(_LOOKALIKE.get(c, c) for c in value))
    value = unicodedata.normalize("NFD", value.casefold())
    value = "".join(c for c in value if unicodedata.category(c) not in ("Mn", "Cf"))
    value = "".join(_LOOKALIKE.get(c, c) for c in value)
    value = re.sub(r"(?<=[a-z])[0135]|[0135](?=[a-z])", lambda m: _DIGITS[m.group()], value)
    value = re.sub(r"\be\.\s?o\b\.?", " eo ", value)
    out = _TOKEN.findall(value.replace("y", "ij"))
    return [_PARTS.get(t, t) if i + 1 < len(out) or i and t in ("n", "z", "o", "w", "m", "t") else t for i, t in enumerate(out)]


def _stripped(tokens: list[str]) -> list[str]:
    a, b = 0, len(tokens)
    while a < b and tokens[a] in _BEFORE:
        a += 1
    if a and a < b and tokens[a] == "gemeente":
        a += 1
    while b > a and tokens[b - 1] in _AFTER:
        b -= 1
    return tokens[a:b]


class NameTrie:
    """All entries and alias paths, searched by simulating a Levenshtein automaton down the branches."""

    def __init__(self):
        self.root: dict = {}

    def add(self, key: str, entry) -> None:
        node = self.root
        for c in key:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(entry)

    def search(self, query: str, most: int):
        """(distance, entry) of all entries within `most` edits; neighbouring letters swapped are one edit.

        Bit i of a state is set if the first i letters of the query can be spelt so far; there is one
        state per number of edits and one more for a half-done swap.
        """
        n = len(query)
        full, accept = (1 << (n + 1)) - 1, 1 << n
        where: dict[str, int] = {}
        for i, c in enumerate(query):
            where[c] = where.get(c, 0) | 1 << i
        start = tuple((1 << (d + 1)) - 1 & full for d in range(most + 1))
        found = []
        stack = [(self.root, start, (0,) * (most + 1))]
        while stack:
            node, states, swaps = stack.pop()
            if "" in node:
                for d, s in enumerate(states):
                    if s & accept:
                        found.extend((d, entry) for entry in node[""])
                        break
            for c, below in node.items():
                if not c:
                    continue
                at = where.get(c, 0)
                after, half = [((states[0] & at) << 1) & full], [0]
                for d in range(1, most + 1):
                    s = (states[d] & at) << 1 | states[d - 1] | states[d - 1] << 1 | after[d - 1] << 1 | (swaps[d] & at) << 2
                    after.append(s & full)
                    half.append(states[d - 1] & at >> 1)
                if after[most]:
                    stack.append((below, tuple(after), tuple(half)))
        return found


def most_edits(length: int) -> int:
    """The length-dependent distance."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 12 else 3


class Resolver:
    """Finds the entry that a typed value means."""

    def __init__(self, entries: list[tuple[str, str, str, list[str] | None]]):
        """entries: (ref_id, kind, name, aliases)."""
        self.exact: dict[str, list] = {}
        self.tries = {False: NameTrie(), True: NameTrie()}
        for ref_id, kind, name, aliases in sorted(entries, key=lambda e: (e[1] != "place", e[0])):
            for spelling in dict.fromkeys([name, *(a for a in aliases or () if a)]):
                tokens = tokens_of(spelling)
                paths = [tokens]
                if kind == "region" and len(tokens) > 1 and tokens[0] in _SIDES:
                    paths.append([*tokens[1:], tokens[0]])
                if len(tokens) > 1 and tokens[0] in _ARTICLES:
                    paths.append([*tokens[1:], tokens[0]])
                for path in paths:
                    key = " ".join(path)
                    entry = (kind, ref_id)
                    if entry not in self.exact.setdefault(key, []):
                        self.exact[key].append(entry)
                        self.tries[False].add(key, entry)
                        if kind == "region":
                            self.tries[True].add(key, entry)
        self.longest = max((k.count(" ") + 1 for k in self.exact), default=1)

    def _whole(self, tokens: list[str], regions: bool, fuzzy: bool):
        """(distance, kind, ref_id) or None for a string taken as one name."""
        key = " ".join(tokens)
        hits = [(0, *e) for e in self.exact.get(key, ()) if not regions or e[0] == "region"]
        if not hits and fuzzy and (most := most_edits(len(key))):
            hits = [(d, *e) for d, e in self.tries[regions].search(key, most)]
        return min(hits, key=lambda h: (h[0], h[1] != "place", h[2]), default=None)

    def resolve(self, value: str, regions: bool = False) -> str:
        """The ref_id, or NONE. With `regions` only entries of kind region can be meant."""
        found = self.ranked(value, regions)
        return found[-1] if found else NONE

    def ranked(self, value: str, regions: bool = False) -> tuple | None:
        """(step, fuzzy, less words, no place, distance, ref_id) of the entry that a value means, None if it means none.

        The smallest of the ranks that parts of a list give is the rank that the whole list gives: steps follow each
        other only where all before found nothing.
        """
        value = _repair(value)
        whole = tokens_of(value)
        pieces = [t for p in _SPLIT.split(value) if (t := tokens_of(p))]
        plain = _stripped(whole)
        tries = [whole, plain, [t for t in plain if t not in _AMID]]
        for fuzzy in (False, True):
            for i, tokens in enumerate(tries):
                if tokens and (hit := self._whole(tokens, regions, fuzzy)):
                    return (3 * fuzzy + i, 0, 0, hit[1] != "place", hit[0], hit[2])
        hits = []
        for fuzzy in (False, True):
            for piece in pieces if len(pieces) > 1 else ():
                for tokens in (piece, _stripped(piece)):
                    if tokens and (hit := self._whole(tokens, regions, fuzzy)):
                        hits.append((6, 0, 0, hit[1] != "place", hit[0], hit[2]))
            if any(not h[3] for h in hits):
                break
        if hits:
            return min(hits)
        # a name within other words: the longest run of tokens that is a name, then one that is nearly a name
        for fuzzy in (False, True):
            for size in range(min(len(whole) - 1, self.longest), 0, -1):
                for i in range(len(whole) - size + 1):
                    run = whole[i : i + size]
                    if (not fuzzy or len(" ".join(run)) >= 8) and (hit := self._whole(run, regions, fuzzy)):
                        hits.append((7, int(fuzzy), -size, hit[1] != "place", hit[0], hit[2]))
                if hits:
                    return min(hits)
        return None


def _parts(reference: DataFrame) -> list[DataFrame]:
    """The reference list (ref_id, kind, name, aliases), cut by a hash into parts of about MOST_ENTRIES at most."""
    rows = reference.where("ref_id is not null and name is not null").select("ref_id", "kind", "name", "aliases")
    n = rows.count()
    if n <= MOST_ENTRIES:
        return [rows]
    parts = 2 * -(-n // MOST_ENTRIES)
    return [rows.where(F.pmod(F.xxhash64("ref_id"), F.lit(parts)) == i) for i in range(parts)]


_WORKER: dict = {}


def map_values(values: DataFrame, key: str, fields: dict[str, bool], reference: DataFrame) -> DataFrame:
    """(key, field, ref_id) of every value of the given columns that is neither null, blank nor exactly a listed name.

    fields: column name -> whether only regions can be meant. ref_id is NONE for a value that names no entry.
    Values are resolved where they are read: each batch resolves its distinct values, each worker keeps what it
    has resolved, and nothing is shuffled, so a value that holds a third of all rows costs no more than another.
    A list of more than MOST_ENTRIES is searched part by part: its distinct values meet each part, the best of the
    parts' answers counts, and answers are joined back to the rows. Repeated keys give repeated rows.
    """
    rows = values.where(F.col(key).isNotNull())
    parts = _parts(reference)
    if len(parts) == 1:
        return _resolved(rows.select(F.col(key).cast("bigint").alias("key"), *fields), list(fields), fields, parts[0].collect(), False).withColumnRenamed("key", key)
    ws = Workspace(values.sparkSession, "canonical")
    long = rows.select(F.col(key).cast("bigint").alias(key), F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in fields])).alias("v")).select(key, "v.*")
    long = ws.write("values", long.where(F.col("value").rlike(r"(?U)\S")))
    names = reference.where("ref_id is not null and name is not null").select(F.col("name").alias("value")).distinct()
    open_ = ws.write("open", long.join(names, "value", "left_anti").select("field", "value").distinct().select(F.monotonically_increasing_id().alias("key"), "field", "value"))
    found = None
    for i, part in enumerate(parts):
        wide = open_.select("key", *[F.when(F.col("field") == n, F.col("value")).alias(n) for n in fields])
        one = ws.write(f"part_{i}", _resolved(wide, list(fields), fields, part.collect(), True))
        found = one if found is None else found.unionAll(one)
    best = found.groupBy("key").agg(F.min("rank").alias("rank"))
    meant = open_.join(best, "key").select("field", "value", F.coalesce("rank.ref_id", F.lit(NONE)).alias("ref_id"))
    return long.join(meant, ["field", "value"]).select(key, "field", "ref_id")


def _resolved(rows: DataFrame, names: list[str], fields: dict[str, bool], entries: list, ranks: bool) -> DataFrame:
    """(key, field, ref_id), or (key, field, rank) for a part of a list, of the values in columns `names` of rows (key, *names)."""
    spark: SparkSession = rows.sparkSession
    entries = spark.sparkContext.broadcast([tuple(e) for e in entries])
    rank = pa.struct([("step", pa.int32()), ("fuzzy", pa.int32()), ("size", pa.int32()), ("no_place", pa.bool_()), ("distance", pa.int32()), ("ref_id", pa.string())])
    last = (99, 0, 0, True, 0, None)
    schema = pa.schema([("key", pa.int64()), ("field", pa.string()), ("rank", rank) if ranks else ("ref_id", pa.string())])

    def run(batches):
        listed = frozenset() if ranks else frozenset(e[2] for e in entries.value)
        mark = hash((ranks, *((e[0], e[2]) for e in entries.value)))
        if _WORKER.get("mark") != mark:
            _WORKER.clear()
            _WORKER.update(mark=mark, resolver=Resolver(entries.value), memo={})
        resolver, memo = _WORKER["resolver"], _WORKER["memo"]
        for batch in batches:
            for at, name in enumerate(names, 1):
                encoded = batch.column(at).dictionary_encode()
                meant = []
                for v in encoded.dictionary.to_pylist():
                    if not v.strip() or v in listed:
                        meant.append(None)
                        continue
                    ref = memo.get((v, fields[name]))
                    if ref is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        ref = memo[v, fields[name]] = dict(zip(rank.names, resolver.ranked(v, fields[name]) or last)) if ranks else resolver.resolve(v, fields[name])
                    meant.append(ref)
                refs = pa.array(meant, schema.types[2]).take(encoded.indices)
                keep = refs.is_valid()
                out = refs.filter(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), pa.array([name] * len(out), pa.string()), out], schema=schema)

    kind = "rank struct<step:int,fuzzy:int,size:int,no_place:boolean,distance:int,ref_id:string>" if ranks else "ref_id string"
    return rows.mapInArrow(run, f"key bigint, field string, {kind}")
