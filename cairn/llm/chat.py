"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the sorted spans of its turns are
laid over the token spans by binary search, which marks the tokens that carry loss.

Template: <|turn|>role<|text|>text<|end|> for each turn. Its three marks, and the other control strings below,
are escaped inside roles and texts: a backslash goes in behind the first character, also where backslashes
already stand there, so taking one away gives the text back. The marks are tokens of their own, so no token
crosses a turn's edge; spans are clipped to the turn all the same.

Turns are ordered by turn (null first), then role and text; repeated rows are turns of their own. A null
text or role is empty; a null conv_id is a conversation of its own. A conversation is one unit of work and has to
fit in a task. Other columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, slices, tidy

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
MARKS = [TURN, TEXT, END]
#: Bytes of conversations that are encoded at once.
STEP_BYTES = 1 << 18
#: Control strings of this template and of common ones.
CONTROL = [*MARKS, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>"]
LOSS_ROLE = "assistant"

_REST = "|".join(re.escape(c[1:]) for c in CONTROL)
_PLAIN = re.compile(rf"([<\[])(?=\\*(?:{_REST}))")
_ESCAPED = re.compile(rf"([<\[])\\(?=\\*(?:{_REST}))")
_PARSED = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.S)

OUT = "conv_id long, n_turns long, formatted string, token_ids array<int>, loss_mask array<boolean>, token_from array<int>, token_to array<int>"


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans, in order, of the texts that carry loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        at += len(head)
        if role == LOSS_ROLE and body:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += [head, body, END]
    return "".join(parts), spans


def load_tokenizer(path: str):
    """The tokenizer of a file, with the template's marks as tokens behind its vocabulary."""
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in MARKS])
    return t


def align(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: whether it meets a span, and its own span clipped to that one. Both are sorted."""
    begin = np.array([s for s, _ in spans], dtype=np.int64)
    end = np.array([e for _, e in spans], dtype=np.int64)
    if not len(begin):
        return np.zeros(len(starts), bool), starts.copy(), starts.copy()
    at = np.searchsorted(end, starts, side="right")
    safe = np.minimum(at, len(begin) - 1)
    hit = (at < len(begin)) & (begin[safe] < ends)
    return hit, np.where(hit, np.maximum(starts, begin[safe]), starts), np.where(hit, np.minimum(ends, end[safe]), starts)


def format_chats(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, n_turns, formatted; token_ids, loss_mask, and each token's characters token_from to token_to."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    ordered = whole.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load_tokenizer(tokenizer)
        for batch in batches:
            for part in slices(batch, STEP_BYTES):
                made = [render(list(zip(r, x, strict=True))) for r, x in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                rows = []
                for (text, spans), e in zip(made, t.encode_batch([m[0] for m in made], add_special_tokens=False), strict=True):
                    offsets = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
                    rows.append((text, e.ids, *align(offsets[:, 0], offsets[:, 1], spans)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(r) for r in part.column(1).to_pylist()], pa.int64()),
                        pa.array([r[0] for r in rows], pa.string()),
                        pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                        pa.array([r[2].tolist() for r in rows], pa.list_(pa.bool_())),
                        pa.array([r[3].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                        pa.array([r[4].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                    ],
                    names=["conv_id", "n_turns", "formatted", "token_ids", "loss_mask", "token_from", "token_to"],
                )

    ready(conversations.sparkSession)
    return ordered.mapInArrow(tidy(run), OUT)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(r), unescape(x)) for r, x in _PARSED.findall(formatted)]


def masked_text(formatted: str, mask: list[bool], starts: list[int], ends: list[int]) -> str:
    """The text under the mask: what its tokens cover, each character once, unescaped for each run of its own."""
    runs: list[list[int]] = []
    for m, a, b in zip(mask, starts, ends, strict=True):
        if m and a < b:
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
    return "".join(unescape(formatted[a:b]) for a, b in runs)


def read_back(formatted_chats: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of what the output holds: the text is decoded from its token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load_tokenizer(tokenizer)
        for batch in (part for whole in batches for part in slices(whole, 4 * STEP_BYTES)):
            cols = {n: batch.column(n).to_pylist() for n in ("conv_id", "token_ids", "loss_mask", "token_from", "token_to")}
            rows = []
            for i, conv in enumerate(cols["conv_id"]):
                text = t.decode(cols["token_ids"][i], skip_special_tokens=False)
                turns = parse(text)
                loss = masked_text(text, cols["loss_mask"][i], cols["token_from"][i], cols["token_to"][i])
                said = "".join(f"{r}\n{x}\n" for r, x in turns)
                rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    ready(formatted_chats.sparkSession)
    return formatted_chats.mapInArrow(tidy(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
