"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once. The lengths of its tokens in bytes give each token's span; spans are
joined with the spans of the document's sections (its lines, each with the line break that ends it) by
one merge over both sorted lists. A token that crosses a boundary goes to the section that
holds most of its bytes, and to the earlier one of equals. So the counts of a document's sections add up
to the count of the document.
"""

import base64
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mnemos.llm.words import append, texts_of

#: Folder and vocabulary (tiktoken ranks) that are used if none are named.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Splits text into the pieces that are encoded by themselves: the public pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Runs of white space that the splitter isn't given: it would keep a state for each character.
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(ranks: dict[bytes, int]):
    """An encoder without special tokens, and the length in bytes of each token."""
    import tiktoken

    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def encoded(enc, text: str) -> list[int]:
    """The tokens of a text of any length.

    The pattern takes a run of white space before a word as one piece but for its last character, and a run at the end of a text whole, so
    long runs are encoded as such pieces and what stands between them as it is.
    """
    out, at = [], 0
    for run in LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += enc.encode_ordinary(text[at : run.start()])
        out += enc._encode_single_piece(text[run.start() : end].encode())
        at = end
    return out + enc.encode_ordinary(text[at:])


def attributed(ends: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Tokens of each section. ends: where tokens end; bounds: where sections begin, and the end of the last."""
    start = np.r_[0, ends[:-1]]
    first = np.searchsorted(bounds, start, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    place = first.copy()
    for i in np.flatnonzero(last > first).tolist():
        cut = np.clip(bounds[first[i] : last[i] + 2], start[i], ends[i])
        place[i] = first[i] + int(np.argmax(np.diff(cut)))
    return np.bincount(place, minlength=len(bounds) - 1)


def line_bounds(text: bytes) -> np.ndarray:
    """Where lines begin, and the end; an empty text is one empty line."""
    at = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    at = at[at < len(text)]
    return np.r_[0, at, len(text)]


def section_counts(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """docs with n_tokens, n_sections and, by section, sections array<struct<start, end, n_tokens>> (byte offsets).

    A null or empty text is one empty section without tokens. Repeated rows are counted each; columns with these
    three names are replaced, others stay. Very long texts are encoded whole, long runs of white space as pieces of their own; an empty table
    stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    built = []

    def make(batch: pa.RecordBatch) -> list:
        if not built:  # once for each task
            built.append(encoder(shared.value))
        enc, sizes = built[0]
        totals, counts, starts, ends, offsets = [], [], [], [], [0]
        for text in texts_of(batch):
            bounds = line_bounds(text)
            ids = np.array(encoded(enc, text.decode()), np.int64)
            n = attributed(np.cumsum(sizes[ids]), bounds) if len(ids) else np.zeros(len(bounds) - 1, np.int64)
            totals.append(len(ids))
            counts.append(n)
            starts.append(bounds[:-1])
            ends.append(bounds[1:])
            offsets.append(offsets[-1] + len(n))
        spans = pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (starts, ends, counts)], ["start", "end", "n_tokens"])
        return [pa.array(totals, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)]

    return append(docs, make, "n_tokens long, n_sections long, sections array<struct<start: long, end: long, n_tokens: long>>")


def default_ranks(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    return load_ranks(os.path.join(folder, vocabulary))
