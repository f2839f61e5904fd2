"""Chat messages: arrays of (role, content), and their rendering and reading."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGE = "array<struct<role:string,content:string>>"


def message(role: Column | str, content: Column | str) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_column(role).cast("string").alias("role"), as_column(content).cast("string").alias("content"))


def adapt(messages: Column, merge_system: bool = False) -> Column:
    """Coalesce neighbours of one role by a blank line; merge_system: a leading system message counts as user."""
    own = messages
    if merge_system:
        own = F.transform(messages, lambda m, k: message(F.when((k == 0) & (m["role"] == "system"), F.lit("user")).otherwise(m["role"]), m["content"]))

    def add(held: Column, m: Column) -> Column:
        last = F.try_element_at(held, F.lit(-1))
        joined = message(m["role"], F.concat(last["content"], F.lit("\n\n"), m["content"]))
        return F.when(last["role"] == m["role"], F.concat(F.slice(held, 1, F.size(held) - 1), F.array(joined))).otherwise(F.concat(held, F.array(message(m["role"], m["content"]))))

    return F.aggregate(own, F.array().cast(MESSAGE), add)


def render(messages: Column, eos: str = "</s>", ask: bool = False) -> Column:
    """Role-tagged text; ask ends with an open assistant turn."""
    each = F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit(f"{eos}\n")))
    return F.concat(F.array_join(each, ""), F.lit("<|assistant|>\n" if ask else ""))


def render_chatml(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")


def read_tagged(text: Column) -> Column:
    """The messages of a text in either of two tagged layouts; role model is assistant.

    A message reaches to the next opening tag, whether it is closed or not; only line ends behind it go.
    """

    def read(opening: str, closing: str) -> Column:
        roles = F.regexp_extract_all(text, F.lit(opening), F.lit(1))
        parts = F.split(text, opening)
        said = lambda k: F.regexp_replace(F.replace(F.get(parts, k + 1), F.lit(closing), F.lit("")), r"\n+\z", "")
        return F.transform(roles, lambda r, k: message(F.when(r == "model", F.lit("assistant")).otherwise(r), said(k)))

    turns = read(r"<start_of_turn>(user|model)\n", "<end_of_turn>")
    return F.when(F.contains(text, F.lit("<start_of_turn>")), turns).otherwise(read(r"<\|im_start\|>(\w+)\n", "<|im_end|>"))


def with_system(messages: Column) -> Column:
    """Put an empty system message in front unless there is one."""
    return F.when(F.get(messages, F.lit(0))["role"] == "system", messages).otherwise(F.concat(F.array(message("system", "")), messages))


def prompt_part(messages: Column) -> Column:
    return F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))


def completion_part(messages: Column) -> Column:
    return F.slice(messages, F.greatest(F.size(messages), F.lit(1)), F.lit(1))


def completion_text(full: Column, prompt: Column, fallback: Column) -> Column:
    """What a full rendering adds to its prompt, or the fallback if it does not begin with it."""
    return F.when(F.startswith(full, prompt), F.substring(full, F.length(prompt) + 1, F.length(full))).otherwise(fallback)


def own_turns(system: Column, turns: Column, speaker: Column) -> Column:
    """A conversation as one speaker has it: the system prompt, own turns as assistant, others as user."""
    said = F.transform(turns, lambda t: message(F.when(t["speaker"] == speaker, F.lit("assistant")).otherwise(F.lit("user")), t["content"]))
    return F.concat(F.array(message("system", system)), said)


def frame_for_loss(text: Column, merge_system: bool = False) -> Column:
    """An utterance as a model's own turn: alone, or after an empty user turn where templates want one."""
    own = [message("assistant", text)]
    return render(F.array(*([message("user", ""), *own] if merge_system else own)))


def as_conversation(said: Column) -> Column:
    """Utterances as messages of the older layout: the first is the system's, all others the assistant's."""
    return F.transform(said, lambda s, k: message(F.when(k == 0, F.lit("system")).otherwise(F.lit("assistant")), s))


def loss_mask(roles: Column, lengths: Column) -> Column:
    """Per token, whether it belongs to an assistant message, for messages of so many tokens."""
    each = F.zip_with(roles, lengths, lambda r, n: F.array_repeat(F.when(r == "assistant", F.lit(1)).otherwise(F.lit(-100)), n))
    return F.flatten(each)


def _starts(ids: np.ndarray, row: np.ndarray, marker: list[int]) -> np.ndarray:
    """Where a marker begins in the ids of many rows, laid end to end; it does not reach over a row's end."""
    count = len(ids) - len(marker) + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    hit = row[:count] == row[len(marker) - 1 :]
    for k, one in enumerate(marker):
        hit &= ids[k : k + count] == one
    return np.flatnonzero(hit)


def _places(row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted rows: how many of each there are, where each begins, and the place of every one in its row."""
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    return count, first, np.arange(len(row)) - first[row]


def _outside_replies(ids: np.ndarray, lengths: np.ndarray, alice: list[int], bob: list[int], you_are_bob: list[int]) -> np.ndarray:
    """For the ids of many rows, laid end to end: whether they lie outside the replies of the row's speaker.

    A reply begins behind the own marker and ends where the other's marker
    begins.  What comes before the first reply is outside, and so is what
    follows a marker of the other that no reply answers.
    """
    rows = len(lengths)
    row = np.repeat(np.arange(rows), lengths)
    begin = np.cumsum(lengths) - lengths
    is_bob = np.zeros(rows, bool)
    is_bob[row[_starts(ids, row, you_are_bob)]] = True
    of_alice, of_bob = _starts(ids, row, alice), _starts(ids, row, bob)
    bob_says_a, bob_says_b = is_bob[row[of_alice]], is_bob[row[of_bob]]

    reply_row = np.concatenate([row[of_alice[~bob_says_a]], row[of_bob[bob_says_b]]])
    reply = np.concatenate([of_alice[~bob_says_a] + len(alice), of_bob[bob_says_b] + len(bob)])
    order = np.lexsort((reply, reply_row))
    reply, reply_row = reply[order], reply_row[order]
    replies, first_reply, _ = _places(reply_row, rows)

    other = np.sort(np.concatenate([of_bob[~bob_says_b], of_alice[bob_says_a]]))
    others, first_other, _ = _places(row[other], rows)
    both = np.flatnonzero((replies > 0) & (others > 0))
    opens = both[other[first_other[both]] > reply[first_reply[both]]]  # rows that begin with the own reply
    other_row = np.concatenate([opens, row[other]])
    other = np.concatenate([begin[opens], other])
    order = np.lexsort((other, other_row))
    other, other_row = other[order], other_row[order]
    others, first_other, place = _places(other_row, rows)

    answered = place < replies[other_row]
    from_ = np.where(place == 0, begin[other_row], other)[answered]
    to = np.maximum(reply[(first_reply[other_row] + place)[answered]], from_)
    left = np.flatnonzero(replies < others)  # the last marker of the other has no answer
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, np.concatenate([from_, other[(first_other + others - 1)[left]]]), 1)
    np.add.at(change, np.concatenate([to, (begin + lengths)[left]]), -1)
    return np.cumsum(change[:-1]) > 0


def _label_lists(ids: pa.Array, alice: list[int], bob: list[int], you_are_bob: list[int], ignore: int) -> pa.Array:
    lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = ids.flatten()  # without the null rows
    known = pc.fill_null(flat.cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    outside = _outside_replies(known, lengths, alice, bob, you_are_bob)
    labels = pc.if_else(pa.array(outside), pa.scalar(ignore, pa.int32()), flat.cast(pa.int32()))
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, labels, mask=pc.is_null(ids))


def reply_labels(ids: list[int], own: list[int], other: list[int], ignore: int = -100) -> list[int]:
    """The labels of one list of ids, for the speaker of the own marker."""
    outside = _outside_replies(np.array(ids, np.int64), np.array([len(ids)]), own, other, [np.iinfo(np.int64).min])
    return np.where(outside, ignore, np.array(ids, np.int64)).tolist()


def label_replies(ids: Column, alice: list[int], bob: list[int], you_are_alice: list[int], you_are_bob: list[int], ignore: int = -100) -> Column:
    """Training labels of token ids: the replies of the speaker that the text addresses (Alice, unless it addresses Bob).

    Markers are searched for in the flat buffer of an Arrow batch, for all its rows at once.
    A null list stays null; a null id is part of no marker.
    """
    from turnmill.shipping import ship

    if not (alice and bob and you_are_bob):
        raise ValueError("a marker has no ids")

    @F.arrow_udf("array<int>")
    def labels(column: pa.Array) -> pa.Array:
        return _label_lists(column, alice, bob, you_are_bob, ignore)

    ship()
    return labels(ids)
