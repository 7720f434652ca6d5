"""Token ids of whole texts by a public byte-level BPE, cut at byte pairs that no token contains."""

from __future__ import annotations

import base64
import importlib.util
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; None: the folder of the package public_tokenizers, else /opt/tokenizers.
DEFAULT_DIR = None
NAME = "byte_bpe_50k"
#: Fragments kept with their ids in a worker's memo.
MEMO = 200_000
#: The splitting pattern of this vocabulary (a fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACE = b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"


def tokenizer_dir(where: str | None = None) -> str:
    if where or DEFAULT_DIR:
        return where or DEFAULT_DIR
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"


class FragmentEncoder:
    """Encodes a text fragment by fragment.

    A merge only ever joins two bytes that stand side by side in some token. Where a pair of neighbouring
    bytes stands in no token, no merge can reach across, so a cut there never changes the ids, provided
    the cut leaves the splitting pattern's pieces as they were: it is taken between two characters, after
    one that is no white space (white space looks ahead), and not beside an apostrophe (contractions).
    Fragments repeat, so most come from a bounded memo.
    """

    def __init__(self, where: str | None = None, name: str = NAME):
        import tiktoken

        with open(os.path.join(tokenizer_dir(where), f"{name}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.encode_fragment = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        together = np.zeros((256, 256), bool)
        for token in ranks:
            together[list(token[:-1]), list(token[1:])] = True
        cut = ~together
        cut[:, 0x80:0xC0] = False  # within a character
        cut[list(_SPACE)] = False
        cut[0x80:] = False  # a last byte of a longer character: it may be a letter's or a space's
        cut[ord("'")] = cut[:, ord("'")] = False
        self.cut, self.memo = cut, {}

    def fragments(self, text: str) -> list[str]:
        data = text.encode("utf-8")
        b = np.frombuffer(data, np.uint8)
        at = np.flatnonzero(self.cut[b[:-1], b[1:]]) + 1
        if not len(at):
            return [text]
        edges = [0, *at.tolist(), len(data)]
        return [data[i:j].decode("utf-8") for i, j in zip(edges, edges[1:])]

    def __call__(self, text: str | None) -> list[int]:
        """Ids of a text; an empty and a null text both give an empty list."""
        if not text:
            return []
        out, memo = [], self.memo
        for piece in self.fragments(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.encode_fragment(piece)
                if len(piece) <= 200:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = ids
            out.extend(ids)
        return out


def encode(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", where: str | None = None, name: str = NAME) -> DataFrame:
    """(id, ids) of every row: strings of special tokens are ordinary text, empty and null texts give an empty list.

    Narrow: no shuffle, any number of rows per id, null ids stay. Texts of any length are encoded whole.
    """

    def run(batches):
        encoder = FragmentEncoder(where, name)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [encoder(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(texts: DataFrame, keep: list[str], text_col: str = "text", where: str | None = None, name: str = NAME) -> DataFrame:
    """The kept columns and `tokens`, the number of ids of each text."""

    def run(batches):
        encoder = FragmentEncoder(where, name)
        for batch in batches:
            n = pa.array([len(encoder(t)) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*keep, "tokens"])

    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    return texts.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"{kinds}, tokens bigint")
