"""Chat formatting with an incremental check of the template.

The template is a black box: a function from a list of turns to a text. Successive prefixes of a
conversation are rendered; where the output for k turns begins with the output for k - 1, the rest is
the span of turn k. A template that changes what it wrote before (for example one that drops earlier
reasoning) is found by outputs that do not begin so, and the conversation is marked. Inside a span
the text is found by rendering the turn with two probe texts: up to the first place where both
outputs differ stands the header, from the last on the trailer.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """Text without the opening ``<|`` of a control string; ``unescape`` gives it back.

    One backslash goes between ``<`` and ``|``, also where there are some, so that nothing collides.
    """
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def marked_turns(turns: list[Turn]) -> str:
    """The template of the registered query: every turn between marks, control strings escaped."""
    return "".join(f"<|im_start|>{_escape_role(role)}\n{escape(text)}<|im_end|>\n" for role, text in turns)


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def read_marked(formatted: str) -> list[Turn]:
    """The turns of an output of ``marked_turns``."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        turns.append((_unescape_role(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def render_spans(turns: list[Turn], template: Callable[[list[Turn]], str]):
    """(output, span of every turn, span of every turn's text, whether history was rewritten).

    Spans are (start, end) in code points of the output; -1, -1 where a rewritten history leaves a
    turn without a place.
    """
    before, spans, texts, rewrites = template([]), [], [], False
    for k, (role, text) in enumerate(turns):
        past = turns[:k]
        output = template([*past, (role, text)])
        first, second = template([*past, (role, "A")]), template([*past, (role, "B")])
        head = _common(first, second)
        tail = _common(first[head:][::-1], second[head:][::-1])
        if not output.startswith(before):
            rewrites = True
            # Spans that lie behind the first changed character no longer hold.
            changed = _common(before, output)
            spans = [s if s[1] <= changed else (-1, -1) for s in spans]
            texts = [s if s[1] <= changed else (-1, -1) for s in texts]
            spans.append((changed, len(output)))
        else:
            spans.append((len(before), len(output)))
        found = head <= len(output) - tail and output[:head] == first[:head]
        texts.append((head, len(output) - tail) if found else (-1, -1))
        before = output
    return before, spans, texts, rewrites


FORMATTED = (
    "conv_id long, n_turns long, formatted string, turn_spans array<struct<start: int, end: int>>, "
    "text_spans array<struct<start: int, end: int>>, loss_spans array<struct<start: int, end: int>>, "
    "rewrites_history boolean"
)


def conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: its turns in order, as an array.

    Nulls: a null text or role is empty, a null conv_id is a conversation of its own, a null turn
    comes first. Equal turn numbers are ordered by role and text; repeated rows stay.
    """
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _pairs(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in spans]


def format_conversations(
    rows: DataFrame,
    template: Callable[[list[Turn]], str] = marked_turns,
    loss_role: str = "assistant",
) -> DataFrame:
    """Format conversations (rows conv_id, turn, role, text) with a black-box template.

    Gives one row per conversation: ``formatted``, the span of every turn and of every text in it,
    ``loss_spans`` (texts of ``loss_role``, for the loss mask) and ``rewrites_history``. An empty
    table gives no rows. Other columns are ignored. A conversation is one text, hence one value;
    its prefixes are rendered in the task that holds it.
    """
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("turn_spans", _SPAN),
         ("text_spans", _SPAN), ("loss_spans", _SPAN), ("rewrites_history", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = []
                for row in batch.slice(start, 256).to_pylist():
                    turns = [(t["role"], t["text"]) for t in row["turns"]]
                    text, spans, texts, rewrites = render_spans(turns, template)
                    loss = [s for s, (role, _) in zip(texts, turns) if role == loss_role and s[0] >= 0]
                    out.append(
                        [row["conv_id"], len(turns), text, _pairs(spans), _pairs(texts), _pairs(loss), rewrites]
                    )
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    return conversations(rows).mapInArrow(run, FORMATTED)


def read_turns(formatted: DataFrame, reader: Callable[[str], list[Turn]] = read_marked) -> DataFrame:
    """Read turns and loss texts back from formatted texts and their spans."""
    kinds = "conv_id long, turns array<struct<role: string, text: string>>, loss_texts array<string>, formatted_chars long"
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    schema = pa.schema(
        [("conv_id", pa.int64()), ("turns", turn), ("loss_texts", pa.list_(pa.string())), ("formatted_chars", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = row["formatted"]
                out.append(
                    {
                        "conv_id": row["conv_id"],
                        "turns": [{"role": r, "text": t} for r, t in reader(text)],
                        "loss_texts": [unescape(text[s["start"] : s["end"]]) for s in row["loss_spans"]],
                        "formatted_chars": len(text),
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, kinds)
