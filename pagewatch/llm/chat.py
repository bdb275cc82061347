"""Chat formatting by incremental black-box rendering, with loss masks read off the output."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Turns that the default template is rendered with at a time: it looks at one turn alone.
CHATML_WINDOW = 64

Turn = tuple[str, str]  # role, text


def escape(text: str) -> str:
    """A text without control strings: backslashes are doubled, and one comes into every <|."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    out, at = [], 0
    while (k := text.find("\\", at)) >= 0:
        own = text[k + 1 : k + 2]
        out += [text[at:k], "\n" if own == "n" else own]
        at = k + 2
    return "".join([*out, text[at:]])


def chatml(turns: list[Turn]) -> str:
    """The template: each turn between marks, its role and its text escaped."""
    return "".join(f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}{END}\n" for role, text in turns)


def chatml_text(span: str) -> Turn:
    """Role and text of a turn's span in the output, as they were."""
    head, _, body = span.removeprefix(START).removesuffix(END + "\n").partition("\n")
    return unescape(head), unescape(body)


def chatml_mask(span: str) -> tuple[int, int]:
    """Where in a turn's span its text lies."""
    return span.index("\n") + 1, len(span) - len(END) - 1


@dataclass
class Spans:
    """Follows one conversation turn by turn. rewrites: some prefix's output isn't a prefix of the next one's.

    window: None renders true prefixes. A number says that the template looks back fewer turns than half of it: then prefixes begin later. Where the first
    one does, the true prefix is rendered too, and a turn's span that isn't the same is an error: the template looks back further than was said.
    """

    render: Callable[[list[Turn]], str]
    window: int | None = None
    recent: list[Turn] = field(default_factory=list)
    before: str | None = None
    rewrites: bool = False
    moved: bool = False

    def add(self, turn: Turn) -> str:
        """The part of the output that is the turn's: what the output of the prefix with it has more than without it."""
        if len(self.recent) == self.window:
            if not self.moved and self.before is not None:
                self.moved = True
                whole = Spans(self.render, None, self.recent[:], self.before, self.rewrites)
                expected = whole.add(turn)
                self.recent, self.before = self.recent[self.window // 2 :], None
                if self.add(turn) != expected or self.rewrites != whole.rewrites:
                    raise ValueError(f"the template looks back further than half of {self.window} turns: give a larger window, or none")
                return expected
            self.recent, self.before = self.recent[self.window // 2 :], None
        if self.before is None:
            self.before = self.render(self.recent) if self.recent else ""
        self.recent.append(turn)
        after = self.render(self.recent)
        if not after.startswith(self.before):
            self.rewrites = True
        same = len(self.before) if after.startswith(self.before) else _common(self.before, after)
        self.before = after
        return after[same:]


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def format_conversations(
    turns: DataFrame,
    render: Callable[[list[Turn]], str] = chatml,
    read: Callable[[str], Turn] = chatml_text,
    mask: Callable[[str], tuple[int, int]] = chatml_mask,
    learn: tuple[str, ...] = ("assistant",),
    window: int | None = None,
) -> DataFrame:
    """A row per turn of conv_id, turn, role, text, in order within a conversation: conv_id, seq (from 0), span, role, text, start,
    loss_start, loss_end (code points of the output; both null where there is no loss), rewrites (so far).

    render is taken as a black box: it gets successive prefixes, and a turn's span is what its output has more than the one
    before. A template whose output for a prefix isn't the beginning of the next rewrites history: its conversations are
    marked, and spans begin where the outputs part. The prefixes are whole, so that a conversation of n turns takes n renderings of up to n
    turns and is held in a task; for a template that looks back fewer turns than half of `window`, giving that renders the latest turns only, and
    conversations of any length stream through a task turn by turn; a template that looks back further is an error where it shows at a conversation's first move. role and text are read back from the span.
    Rows sort by turn, role and text; a null turn comes first, a null role or text counts as empty; null conversations are
    one conversation. Repeated rows are turns of their own. Other columns aren't read; an empty table gives none.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, spans, seq, at = object(), Spans(render, window), 0, 0
        for batch in batches:
            rows = []
            for conv, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if conv != current:
                    current, spans, seq, at = conv, Spans(render, window), 0, 0
                span = spans.add((role, text))
                own_role, own_text = read(span)
                lo, hi = mask(span) if own_role in learn else (None, None)
                rows.append((conv, seq, span, own_role, own_text, at, None if lo is None else at + lo, None if hi is None else at + hi, spans.rewrites))
                seq, at = seq + 1, at + len(span)
            cols = list(zip(*rows, strict=True)) or [()] * 9
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            names = ("conv_id", "seq", "span", "role", "text", "start", "loss_start", "loss_end", "rewrites")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=list(names))

    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_.mapInArrow(stream, "conv_id long, seq long, span string, role string, text string, start long, loss_start long, loss_end long, rewrites boolean")


def conversation_digests(formatted: DataFrame, plain: Callable[[str], str] = unescape) -> DataFrame:
    """A row per conversation of format_conversations' rows, as they come: what was read back and what the loss mask covers.

    plain turns what the mask covers into the text as it was: it has to fit the template. Digests go on from turn to turn, so that a conversation of any length takes no room.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        state = None

        def close():
            conv, n, turns, chars, loss, total, rewrites = state
            rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total, rewrites))

        def out():
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            x = [batch[k].to_pylist() for k in ("conv_id", "seq", "span", "role", "text", "start", "loss_start", "loss_end", "rewrites")]
            for conv, seq, span, role, text, start, lo, hi, rewrites in zip(*x, strict=True):
                if seq == 0:
                    if state:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if lo is not None:
                    own = plain(span[lo - start : hi - start])
                    state[3] += len(own)
                    state[4].update(own.encode())
                state[5] += len(span)
                state[6] = rewrites
            if rows:
                yield out()
        if state:
            close()
            yield out()

    return formatted.mapInArrow(stream, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")
