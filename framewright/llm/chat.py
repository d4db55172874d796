"""Chat formatting by tokens: encoded segments, spliced reserved ids, loss masks, escaped control strings."""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "␛"
#: What the template and well-known templates use as marks.
CONTROL = (
    "<|system|>", "<|user|>", "<|assistant|>", "<|role|>", "<|text|>", "<|end|>", "<|endoftext|>",
    "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
ROLES = ("system", "user", "assistant")
_FIND = re.compile(f"{ESCAPE}|(?=(?:{'|'.join(map(re.escape, CONTROL))})).", re.DOTALL)
_BACK = re.compile(f"{ESCAPE}([{ESCAPE}-])")


def escape(text: str) -> str:
    """Breaks every control string after its first character, and doubles the escape character."""
    return _FIND.sub(_broken, text)


def _broken(m: re.Match) -> str:
    return ESCAPE * 2 if m[0] == ESCAPE else f"{m[0]}{ESCAPE}-"


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: ESCAPE if m[1] == ESCAPE else "", text)


@dataclass
class Template:
    """Reserved ids follow the tokenizer's own: one for each role, then role, text and end."""

    path: str
    first: int

    @property
    def tokenizer(self):
        return _tokenizer(self.path)

    def __post_init__(self):
        self.role_id = {r: self.first + i for i, r in enumerate(ROLES)}
        self.named, self.text, self.end = (self.first + len(ROLES) + i for i in range(3))
        self.mark = {v: f"<|{k}|>" for k, v in self.role_id.items()} | {self.named: "<|role|>", self.text: "<|text|>", self.end: "<|end|>"}


@functools.cache
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def _encode(template: Template, loss_roles: tuple[str, ...]):
    """Ids and loss mask of each turn by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            known = [r in template.role_id for r in roles]
            encode = lambda s: [e.ids for e in template.tokenizer.encode_batch([escape(x) for x in s], add_special_tokens=False)]
            bodies, names = encode(texts), iter(encode([r for r, k in zip(roles, known, strict=True) if not k]))
            heads = [[template.role_id[r]] if k else [template.named, *next(names), template.text] for r, k in zip(roles, known, strict=True)]
            # segments: head, body, end of every turn; the mask is a running sum of marks at the edges of bodies
            sizes = np.array([n for h, b in zip(heads, bodies, strict=True) for n in (len(h), len(b), 1)], np.int64)
            edge = np.concatenate(([0], np.cumsum(sizes)))
            ids = np.fromiter((i for h, b in zip(heads, bodies, strict=True) for part in (h, b, (template.end,)) for i in part), np.int32, edge[-1])
            lossy = np.array([r in loss_roles for r in roles], np.int64)
            marks = np.zeros(edge[-1] + 1, np.int64)
            np.add.at(marks, edge[1:-1:3], lossy)
            np.add.at(marks, edge[2::3], -lossy)
            mask = np.cumsum(marks)[:-1].astype(np.int8)
            at = pa.array(edge[::3].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(at, pa.array(ids)), pa.ListArray.from_arrays(at, pa.array(mask))], [*batch.schema.names, "ids", "loss_mask"])

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers turns and adds up their tokens; what a conversation has had before is carried to the next batch."""
    last, number, tokens = object(), 0, 0
    for batch in batches:
        turn, start = [], []
        for conv, n in zip(batch.column(0).to_pylist(), batch.column(1).value_lengths().to_pylist(), strict=True):
            if conv != last or not number:
                last, number, tokens = conv, 0, 0
            turn.append(number)
            start.append(tokens)
            number, tokens = number + 1, tokens + n
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(turn, pa.int64()), pa.array(start, pa.int64()), batch.column(1), batch.column(2)], ["conv_id", "turn_number", "token_start", "ids", "loss_mask"])


def format_turns(
    turns: DataFrame, tokenizer: str, first_reserved: int, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """Token ids and loss mask of every turn, in order within each conversation.

    Columns: ``conv_id, turn_number`` (from 0), ``token_start`` (tokens of the
    conversation before it), ``ids`` (reserved id of the role, the text's own ids,
    reserved end id) and ``loss_mask`` (1 on the text of ``loss_roles``).  Other
    roles are spelled out between two reserved ids.  Segments are encoded one by
    one, so no content can become a reserved id; control strings in content are
    escaped, reversibly.

    Rows of a conversation go by turn, ties by role and text; repeated rows are
    turns of their own; a null turn comes first.  Null roles and texts are empty,
    null conversation ids are one conversation.  Turns are encoded where they are
    read; only numbering follows a conversation from first to last, in batches, so
    it is never held as a whole.  An empty table gives an empty result.
    Texts are read whole, however long; other columns are ignored.
    """
    rows = turns.select(
        turns[conv_col].alias("conv_id"), turns[turn_col].alias("turn"),
        F.coalesce(turns[role_col].cast("string"), F.lit("")).alias("role"), F.coalesce(turns[text_col].cast("string"), F.lit("")).alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    rows = rows.mapInArrow(_encode(Template(tokenizer, first_reserved), loss_roles), f"{kinds}, ids array<int>, loss_mask array<tinyint>")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "loss_mask")
    return rows.mapInArrow(_number, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, turn_number long, token_start long, ids array<int>, loss_mask array<tinyint>")


def _digest(template: Template):
    def read(ids: list[int], mask: list[int]) -> tuple[str, str, str, int]:
        """Role, text, the text under the mask and the length of the rendered turn."""
        decode = lambda x: template.tokenizer.decode(x, skip_special_tokens=False) if x else ""
        cut = ids.index(template.text) if ids[0] == template.named else 0
        role, body = decode(ids[1:cut]), decode(ids[cut + 1 : -1])
        lossy = decode([i for i, m in zip(ids, mask, strict=True) if m])
        shown = len(template.mark[ids[0]]) + len(body) + len(template.mark[ids[-1]]) + (len(role) + len(template.mark[template.text]) if cut else 0)
        name = unescape(role) if cut else template.mark[ids[0]][2:-2]
        return name, unescape(body), unescape(lossy), shown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def done(out: list) -> list[pa.Array]:
            cols = list(zip(*((c, n, t.hexdigest(), lc, ls.hexdigest(), fc) for c, n, t, lc, ls, fc in out), strict=True))
            return [pa.array(cols[i], k) for i, k in enumerate((batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        batch = None
        for batch in batches:
            out = []
            for conv, number, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn_number", "ids", "loss_mask")), strict=True):
                if number == 0:
                    if state:
                        out.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, lossy, shown = read(ids, mask)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(lossy)
                state[4].update(lossy.encode())
                state[5] += shown
            if out:
                yield pa.RecordBatch.from_arrays(done(out), names)
        if state:
            yield pa.RecordBatch.from_arrays(done([state]), names)

    return run


def read_back(formatted: DataFrame, tokenizer: str, first_reserved: int) -> DataFrame:
    """Digests of conversations, decoded from the ids and masks of ``format_turns`` as it returns them.

    Columns: ``conv_id, n_turns, turns_sha256`` (role, newline, text, newline per
    turn), ``loss_chars, loss_sha256`` (unescaped text under the mask) and
    ``formatted_chars`` (of the rendered template).
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(
        _digest(Template(tokenizer, first_reserved)),
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
