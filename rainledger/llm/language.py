"""Languages of documents and of their segments by rank-order n-gram profiles."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rainledger.storage import Workspace

LANGUAGES = ("nl", "en", "de", "fr")
#: Length of a language's profile and longest n-gram.
PROFILE, LONGEST = 2000, 4
#: Labelled articles per language from which the profiles are learned.
SAMPLE = 500
#: Letters that a line needs to be judged, and a segment to stand by itself.
LEAST_LETTERS, SEGMENT_LETTERS = 40, 24
#: Letters that a segment in no known language needs to stand by itself.
UNKNOWN_LETTERS = 80
#: A line judged against its label with less confidence still counts in the second pass of the fit.
UNSURE = 0.2
#: Share of its words that a segment has in some profile at least; with less it is in no language of the profiles.
LEAST_KNOWN = 0.1
_BITS = 6

# Names of the languages in labels.
_NAMES = {
    "nl": ["nl", "nld", "dut", "dutch", "nederlands", "nederlandse taal", "niederländisch", "néerlandais", "hollands", "vlaams", "flemish", "flamand"],
    "en": ["en", "eng", "english", "engels", "englisch", "anglais"],
    "de": ["de", "deu", "ger", "german", "deutsch", "duits", "allemand"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais", "frans", "französisch", "fransk"],
}
_WORDS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”“»«’)]*\s+|\)\s+|\s+(?=\()")


def named_language(label: Column) -> Column:
    """The language a label names by code or name, with or without a country; null for none."""
    plain = F.lower(F.trim(label))
    plain = F.regexp_replace(plain, r"\s*\(.*\)\s*$", "")
    short = F.regexp_replace(plain, r"[-_]\p{L}{2,4}$", "")
    out = F.lit(None).cast("string")
    for lang, names in _NAMES.items():
        out = F.when(plain.isin(names) | short.isin(names), lang).otherwise(out)
    return out


class _Alphabet:
    """Letters as small numbers: 0 a blank, 1 to 61 letters, 62 another letter, 63 the end of a segment."""

    def __init__(self, signs: str):
        self.table = np.full(0x250, 62, np.uint8)
        self.table[32], self.table[10] = 0, 63
        for i, c in enumerate(signs[:61], 1):
            self.table[ord(c)] = i

    def __call__(self, text: str) -> np.ndarray:
        at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.table[np.minimum(at, 0x24F)].astype(np.int64)


_ALPHABET = _Alphabet("abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøœùúûüýÿß")


#: Codes of words start here; those of character n-grams, six bits a sign and the length above, lie below.
_WORD_CODES = 1 << 50


def _characters(segments: list[list[str]]):
    """Yields (n, codes, owner) of the character n-grams of each segment's words, with a blank before and after a word."""
    plain = [f" {' '.join(words)} \n".lower() for words in segments]
    text = "".join(plain)
    at = _ALPHABET(text)
    owner = np.repeat(np.arange(len(plain)), [len(p) for p in plain])
    code, ok, blank = at, at < 62, at == 0
    for n in range(2, LONGEST + 1):
        size = len(at) - n + 1
        code = code[:size] << _BITS | at[n - 1 :]
        ok = ok[:size] & (at[n - 1 :] < 62)
        if n > 2:
            ok &= ~blank[n - 2 : n - 2 + size]  # a gram lies within one word
        yield n, code[ok], owner[:size][ok]


class _WordCodes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        code = self[word] = _WORD_CODES | xxhash.xxh3_64_intdigest(word) & (_WORD_CODES - 1)
        return code


_CODES = _WordCodes()


def _words(segments: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(segments)), [len(words) for words in segments])
    return np.array([_CODES[w.lower()] for words in segments for w in words], np.int64), owner


class _Table:
    """Ranks of one kind of n-gram in all languages; n-grams are numbered by their best rank."""

    def __init__(self, ranks: list[list[int]]):
        at = {}
        for place in range(max(map(len, ranks), default=0)):
            for own in ranks:
                if place < len(own):
                    at.setdefault(own[place], len(at))
        self.at, self.miss = at, PROFILE
        self.rank = np.full((len(ranks), max(1, len(at))), self.miss, np.int32)
        for i, own in enumerate(ranks):
            self.rank[i, [at[c] for c in own]] = np.arange(len(own))

    def add(self, out: np.ndarray, owner: np.ndarray, gram: np.ndarray) -> None:
        """Adds the mean out-of-place distance (1: the n-gram isn't in the profile) of each owner's n-grams."""
        key, count = np.unique(owner << 16 | gram, return_counts=True)
        most = (1 << 24) - 1  # no text of a batch has more n-grams
        key = np.sort(key >> 16 << 40 | (most - count) << 16 | key & 0xFFFF)
        owner, gram = key >> 40, key & 0xFFFF
        if not len(key):
            return
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        n = np.diff(np.concatenate([begin, [len(owner)]]))
        place = np.arange(len(owner)) - np.repeat(begin, n)
        for i, rank in enumerate(self.rank):
            rank = rank[gram]
            cost = np.where(rank == self.miss, self.miss, np.abs(rank - place))
            out[owner[begin], i] += np.add.reduceat(cost, begin) / n / self.miss - 1


class Profiles:
    """Rank-order profiles (Cavnar and Trenkle, 1994), compared by out-of-place distance in numpy batches.

    A language has a profile of character n-grams and one of words. A segment's profile holds the n-grams
    that stand in at least one language's profile; others would cost all languages the same.
    """

    def __init__(self, ranks: dict[str, list[int]]):
        """ranks: language -> codes of n-grams and words, most frequent first."""
        self.languages = [lang for lang in LANGUAGES if lang in ranks]
        self.characters = _Table([[c for c in ranks[x] if c < _WORD_CODES][:PROFILE] for x in self.languages])
        self.words = _Table([[c for c in ranks[x] if c >= _WORD_CODES][:PROFILE] for x in self.languages])
        self.lookup: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"lookup": {}}

    def _lookup(self, n: int) -> np.ndarray:
        if n not in self.lookup:
            table = self.lookup[n] = np.full(1 << _BITS * n, -1, np.int32)
            own = [(c & ((1 << 40) - 1), i) for c, i in self.characters.at.items() if c >> 40 == n]
            if own:
                table[[c for c, _ in own]] = [i for _, i in own]
        return self.lookup[n]

    def distances(self, segments: list[list[str]]) -> np.ndarray:
        """Distance, 0 to 2, of each segment (a list of words) to each language; 2 to all for one of another language,
        of whose words less than LEAST_KNOWN stand in any profile."""
        out = np.full((len(segments), len(self.languages)), 2.0)
        owners, grams = [], []
        for n, code, owner in _characters(segments):
            gram = self._lookup(n)[code]
            known = gram >= 0
            owners.append(owner[known])
            grams.append(gram[known].astype(np.int64))
        self.characters.add(out, np.concatenate(owners), np.concatenate(grams))
        code, owner = _words(segments)
        get = self.words.at.get
        gram = np.array([get(c, -1) for c in code.tolist()], np.int64)
        self.words.add(out, owner[gram >= 0], gram[gram >= 0])
        known = np.bincount(owner[gram >= 0], minlength=len(segments)) / np.maximum(1, np.bincount(owner, minlength=len(segments)))
        out[known < LEAST_KNOWN] = 2.0
        return out


def segments_of(line: str) -> list[tuple[list[str], int]]:
    """(words, letters) of the sentences of a line, short ones joined to the one before."""
    out: list[tuple[list[str], int]] = []
    for part in _SENTENCE.split(line):
        words = _WORDS.findall(part)
        if n := sum(map(len, words)):
            if out and (n < SEGMENT_LETTERS or out[-1][1] < SEGMENT_LETTERS):
                out[-1] = (out[-1][0] + words, out[-1][1] + n)
            else:
                out.append((words, n))
    return out


def judged_lines(profiles: Profiles, texts: list[str]):
    """(text number, line number, language, confidence) of the lines of at least LEAST_LETTERS letters."""
    where, parts = [], []
    for i, text in enumerate(texts):
        for j, line in enumerate(text.split("\n")):
            own = segments_of(line) if len(line) >= LEAST_LETTERS else []
            if sum(n for _, n in own) >= LEAST_LETTERS:
                where.append((i, j))
                parts.append(own)
    return [(*w, *r) for w, r in zip(where, judge(profiles, parts))]


def _best(profiles: Profiles, segments: list[list[str]]) -> list[tuple[int, float]]:
    """(number of the language, margin) of each segment, -1 where no language fits. The margin is the relative distance to the next language."""
    if not segments or not profiles.languages:
        return [(-1, 0.0)] * len(segments)
    d = profiles.distances(segments)
    best, near = d.argmin(axis=1), d.min(axis=1)
    if d.shape[1] > 1:
        two = np.partition(d, 1, axis=1)[:, :2]
        margin = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)
    else:
        margin = np.ones(len(segments))
    return list(zip(np.where(near < 2.0, best, -1).tolist(), margin.tolist()))


def _verdict(profiles: Profiles, own: list[tuple[int, float, int]]) -> tuple[str | None, float]:
    """(language, confidence) of what consists of segments (number of the language, margin, letters): the language that
    holds most letters, and its share of all letters times the mean margin of its segments, four times and at most 1."""
    weight, sure = [0] * (len(profiles.languages) + 1), [0.0] * (len(profiles.languages) + 1)
    for i, margin, n in own:
        weight[i] += n
        sure[i] += n * margin
    most = max(weight, default=0)
    i = weight.index(most) if most else -1
    if not most or i == len(profiles.languages):
        return None, 0.0
    return profiles.languages[i], most / sum(weight) * min(1.0, 4 * sure[i] / most)


def judge(profiles: Profiles, parts: list[list[tuple[list[str], int]]]) -> list[tuple[str | None, float]]:
    """(language, confidence) of each line, given as segments_of gives it; see _verdict."""
    best, out, at = _best(profiles, [words for p in parts for words, _ in p]), [], 0
    for p in parts:
        out.append(_verdict(profiles, [(*best[at + i], n) for i, (_, n) in enumerate(p)]))
        at += len(p)
    return out


def judged_text(profiles: Profiles, texts: list[str | None]):
    """For each text (language, confidence, segments); segments are runs of sentences of one language over line ends:
    (first line, last line, letters, language, confidence). A text without letters has no language, confidence 0 and no segment."""
    lines = [[(j, *s) for j, line in enumerate((t or "").split("\n")) for s in segments_of(line)] for t in texts]
    best, at = _best(profiles, [words for own in lines for _, words, _ in own]), 0
    for own in lines:
        found = [(*best[at + i], n) for i, (_, _, n) in enumerate(own)]
        at += len(own)
        runs: list[list[int]] = []
        for i, (lang, _, n) in enumerate(found):
            # a run begins where the language changes; what is too short to be judged by itself goes with what is before it
            if not runs or n >= SEGMENT_LETTERS and lang != found[runs[-1][0]][0]:
                runs.append([])
            runs[-1].append(i)
        # what is short and of no language (headings, dates) goes with what is before it, at the beginning with what follows
        joined: list[list[int]] = []
        for r in runs:
            letters = sum(found[i][2] for i in r)
            if joined and letters < UNKNOWN_LETTERS and _verdict(profiles, [found[i] for i in r])[0] is None:
                joined[-1] += r
            elif joined and len(joined) == 1 and sum(found[i][2] for i in joined[0]) < UNKNOWN_LETTERS and _verdict(profiles, [found[i] for i in joined[0]])[0] is None:
                joined[0] += r
            elif joined and _verdict(profiles, [found[i] for i in joined[-1]])[0] == _verdict(profiles, [found[i] for i in r])[0]:
                joined[-1] += r
            else:
                joined.append(r)
        runs = joined
        segments = [(own[r[0]][0], own[r[-1]][0], sum(found[i][2] for i in r), *_verdict(profiles, [found[i] for i in r])) for r in runs]
        yield (*_verdict(profiles, found), segments)


def fit_profiles(labelled: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles from rows (id, lang, text) of at most `sample` ids per language, chosen by a hash of the id.

    Two passes: the second counts only the lines that the first pass gives the language of their label, so
    wrong labels and mixed texts do not blur the profiles. A line that stands in articles
    of several labels (a page line, a copy) counts for the label of most of them only. n-grams are counted where the texts are and only
    the PROFILE most frequent of each language come to the driver.
    """
    ws = Workspace(labelled.sparkSession, "profiles")
    rows = labelled.where("lang is not null and text is not null").select("id", "lang", "text")
    picked = None
    for lang in LANGUAGES:
        some = rows.where(F.col("lang") == lang).select("id", "lang").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
        picked = some if picked is None else picked.unionAll(some)
    texts = rows.join(picked, ["id", "lang"], "left_semi").groupBy("id").agg(F.min(F.struct("lang", "text")).alias("r")).select("id", "r.*")
    # a line that stands under labels of several languages is the page's: it speaks for the one most of its articles name
    lines = texts.select("id", "lang", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("text")).withColumn("form", F.regexp_replace(F.lower(F.trim("text")), r"[\s\d]+", " "))
    lines = ws.write("lines", lines)
    own = lines.groupBy("form", "lang").agg(F.count_distinct("id").alias("n")).groupBy("form").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"))
    chosen = ws.write("sample", lines.join(own, ["form", "lang"], "left_semi").select("lang", "text").repartition(4, F.xxhash64("text")))
    profiles = None
    for _ in range(2):
        profiles = Profiles(_count(chosen, profiles))
    ws.drop("sample")
    return profiles


def _count(chosen: DataFrame, profiles: Profiles | None) -> dict[str, list[int]]:
    def run(batches):
        found: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if profiles is None:
                lines = [(lang, segments_of(line)) for lang, text in zip(langs, texts) for line in text.split("\n")]
                lines = [x for x in lines if sum(n for _, n in x[1]) >= LEAST_LETTERS]
            else:
                good = {(i, j) for i, j, at, sure in judged_lines(profiles, texts) if at == langs[i] or sure < UNSURE}
                lines = [(langs[i], segments_of(text.split("\n")[j])) for i, text in enumerate(texts) for j in range(text.count("\n") + 1) if (i, j) in good]
            for lang in LANGUAGES:
                if own := [words for at, parts in lines if at == lang for words, _ in parts]:
                    found.setdefault(lang, []).extend(code | n << 40 for n, code, _ in _characters(own))
                    found[lang].append(_words(own)[0])
        for lang, codes in found.items():
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code), pa.array(n)], names=["lang", "code", "n"])

    counts = chosen.select("lang", "text").mapInArrow(run, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang", F.col("code") >= _WORD_CODES).orderBy(F.desc("n"), "code"))
    out: dict[str, list[int]] = {}
    for r in counts.withColumn("place", place).where(F.col("place") <= PROFILE).orderBy("lang", "place").collect():  # at most 2 PROFILE rows a language
        out.setdefault(r["lang"], []).append(r["code"])
    return out


def line_languages(texts: DataFrame, profiles: Profiles, keep: list[str]) -> DataFrame:
    """The kept columns with line_no, lang and confidence of every line of at least LEAST_LETTERS letters.

    Narrow: texts are judged where they are read. Null texts have no lines.
    """
    sent = texts.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                found = judged_lines(sent.value, part.column(part.num_columns - 1).to_pylist())
                kept = [c.take(pa.array([i for i, *_ in found], pa.int64())) for c in part.columns[:-1]]
                lines = [pa.array([f[k] for f in found], kind) for k, kind in ((1, pa.int32()), (2, pa.string()), (3, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*kept, *lines], names=[*keep, "line_no", "lang", "confidence"])

    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    return texts.where("text is not null").select(*keep, "text").mapInArrow(run, f"{kinds}, line_no int, lang string, confidence double")


def mislabelled_lines(texts: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id, line_no, lang, confidence) of every judged line whose language is not the one its label names.

    texts: (id, text), labels: (id, lang_label); other columns are ignored. Rows of one id count once and are
    expected to hold the same text. A null, blank or unknown label, or none, names no language: then all judged
    lines are cases. Of several labels for one id the smallest named one counts.
    """
    texts = texts.where("id is not null").select("id", "text")
    named = named_labels(labels)
    profiles = fit_profiles(texts.join(named.where("lang is not null"), "id"), sample)
    lines = line_languages(texts, profiles, ["id"]).where("lang is not null").distinct()
    return lines.join(named.withColumnRenamed("lang", "label"), "id", "left").where("label is null or label <> lang").select("id", "line_no", "lang", "confidence")


def named_labels(labels: DataFrame) -> DataFrame:
    """(id, lang) of labels (id, lang_label): the smallest named language of each id, null for none."""
    return labels.where("id is not null").groupBy("id").agg(F.min(named_language(F.col("lang_label"))).alias("lang"))


def document_languages(texts: DataFrame, profiles: Profiles) -> DataFrame:
    """(id, lang, confidence, segments) of each text (id, text), segments as an array of structs (first_line, last_line,
    letters, lang, confidence) in the order of the text.

    Every text is judged as a whole, whatever the length of its lines. Null texts and texts without letters have a null
    language, confidence 0 and no segment; so have texts in a language that has no profile, but with segments.
    Narrow; repeated ids give repeated rows.
    """
    sent = texts.sparkSession.sparkContext.broadcast(profiles)
    kind = pa.list_(pa.struct([("first_line", pa.int32()), ("last_line", pa.int32()), ("letters", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                made = list(judged_text(sent.value, part.column(1).to_pylist()))
                rows = [[dict(zip(("first_line", "last_line", "letters", "lang", "confidence"), s)) for s in segments] for *_, segments in made]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64()), pa.array(rows, kind)], names=["id", "lang", "confidence", "segments"])

    segment = "struct<first_line:int,last_line:int,letters:int,lang:string,confidence:double>"
    return texts.select("id", "text").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, lang string, confidence double, segments array<{segment}>")
