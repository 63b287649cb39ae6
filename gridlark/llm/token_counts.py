"""Offset-mapped token counts: a document is encoded once, and its tokens are attributed to sections.

A token's character span runs from the character that holds its first byte to the one that holds its
last byte. Sections are character spans in order that do not overlap; by default they are the lines of
the text, without their line feeds. Token spans and sections are joined as intervals by binary search.

The rule for a token that no single section holds whole:

* ``n_tokens``: the section that holds most of its characters gets it, the earlier one at a tie; a token
  that lies in no section (a line feed) goes to the section before it, or to the first one;
* ``share``: the token is split in proportion to its characters in each section; characters in no section
  count for the section that the rule above names.

So over a document ``n_tokens`` and ``share`` both add up to its count of tokens. ``n_crossing`` is the
number of tokens that touch a section and also something outside of it.

Null and empty texts are one empty section without tokens; an empty table gives no rows. Repeated rows are
attributed each on its own. Texts of any length are encoded whole, long runs of white space included.
Only ``doc_id``, ``text`` and the named sections column are read.
"""

from __future__ import annotations

import base64
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import sliced, texts

TOKENIZER = "byte_bpe_50k.tiktoken"
#: White space as the encoder's pattern has it (fixed: Unicode's White_Space), and runs of it that are cut out first.
BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
LONG_RUN = 5_000


def load_encoding(path: str):
    """A tiktoken encoding of a rank file, and the byte length of each of its tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def encoded(encoding, text: str) -> list[int]:
    """The ids of a text, whatever runs of white space it has.

    The encoder's pattern makes one piece of such a run, without its last sign if more follows, and backtracks over it
    with a stack that a long run exhausts. So long runs are cut out at these places, which the pattern cuts at anyway.
    """
    if len(text) <= LONG_RUN:
        return encoding.encode_ordinary(text)
    ids, at = [], 0
    for m in BLANK.finditer(text):
        if m.end() - m.start() > LONG_RUN:
            end = m.end() - (m.end() < len(text))
            ids += encoding.encode_ordinary(text[at : m.start()])
            ids += encoding._encode_single_piece(text[m.start() : end])
            at = end
    return ids + encoding.encode_ordinary(text[at:])


def token_spans(raw: bytes, ids, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First characters, and ends, of the tokens of a text."""
    ends = np.cumsum(lengths[np.asarray(ids, np.int64)])
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    if not raw.isascii():
        char = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
        return char[starts], char[ends - 1] + 1
    return starts, ends


def line_sections(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(raw, np.uint8)
    breaks = np.nonzero(a == 10)[0]
    if not raw.isascii():
        breaks = (np.cumsum((a & 0xC0) != 0x80) - 1)[breaks]
    size = int(((a & 0xC0) != 0x80).sum())
    return np.concatenate([[0], breaks + 1]).astype(np.int64), np.concatenate([breaks, [size]]).astype(np.int64)


def attribute(ts: np.ndarray, te: np.ndarray, ss: np.ndarray, se: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, crossing tokens and shares of each section, by the rule of this module."""
    n = len(ss)
    count, crossing, share = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    if not len(ts) or not n:
        return count, crossing, share
    first = np.searchsorted(se, ts, "right")  # of the sections that end after the token's start
    last = np.searchsorted(ss, te, "left") - 1  # of those that start before its end
    inside = (first == last) & (ss[np.minimum(first, n - 1)] <= ts) & (se[np.minimum(first, n - 1)] >= te)
    whole = np.bincount(first[inside], minlength=n)
    count += whole
    share += whole
    for k in np.nonzero(~inside)[0]:
        a, b, lo, hi = int(first[k]), int(last[k]), int(ts[k]), int(te[k])
        held = [(min(hi, int(se[i])) - max(lo, int(ss[i])), -i) for i in range(a, b + 1)]
        held = [x for x in held if x[0] > 0]
        owner = -max(held)[1] if held else max(0, a - 1)
        count[owner] += 1
        outside = hi - lo - sum(x for x, _ in held)
        share[owner] += outside / (hi - lo)
        for x, i in held:
            share[-i] += x / (hi - lo)
            crossing[-i] += 1
    return count, crossing, share


def attributed_tokens(docs: DataFrame, *, sections: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """A row for each section: doc_id, section, char_start, char_end, n_tokens, n_crossing, share.

    sections: a column ``array<struct<start int, end int>>`` of character spans; lines if not given. A
    null or empty array is one section over the whole text. tokenizer: a rank file that every executor
    has; by default that of the installed vocabulary package.
    """
    schema = "doc_id long, section int, char_start long, char_end long, n_tokens long, n_crossing long, share double"

    def kernel(batches):
        import public_tokenizers
        import pyarrow as pa

        encoding, lengths = load_encoding(tokenizer or public_tokenizers.path(TOKENIZER))
        for batch in sliced(batches):
            out: list[list] = [[] for _ in range(7)]
            spans = batch.column(2).to_pylist() if sections else [None] * batch.num_rows
            for doc, raw, given in zip(batch.column(0).to_pylist(), texts(batch), spans, strict=True):
                ts, te = token_spans(raw, encoded(encoding, raw.decode()), lengths)
                if sections is None:
                    ss, se = line_sections(raw)
                else:
                    given = given or [{"start": 0, "end": len(raw.decode())}]
                    ss, se = (np.array([x[k] for x in given], np.int64) for k in ("start", "end"))
                for column, values in zip(out[1:], (np.arange(len(ss), dtype=np.int32), ss, se, *attribute(ts, te, ss, se)), strict=True):
                    column.append(values)
                out[0].append([doc] * len(ss))
            ids = pa.array([x for part in out[0] for x in part], pa.int64())
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([ids] + [pa.array(np.concatenate(c)) for c in out[1:]], names)

    return docs.select("doc_id", "text", *[sections] * bool(sections)).mapInArrow(kernel, schema)
