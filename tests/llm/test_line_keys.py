import random

import pytest

from turnmill.llm import line_dedup as ld

from .test_line_dedup import brute, edited


def template(seed, n):
    """Lines of one template: numbers within two edits of each other or not, some lines edited elsewhere."""
    rnd = random.Random(seed)
    numbers = [f"{rnd.randrange(10**9):09d}" for _ in range(n)]
    numbers += [edited(rnd, x, 2, "0123456789") for x in numbers[: n // 3]]
    lines = [f"GET /items/{x} took some time to answer" for x in numbers]
    return list(enumerate(lines + [edited(rnd, x, 3, "abé") for x in lines[: n // 4]]))


def same_as_brute_force(spark, docs):
    got = ld.line_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).drop("text_key").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, ld.EDITS, ld.MIN_CHARS, ld.MIN_COPIES)


def counted(monkeypatch, name):
    calls, real = [], getattr(ld, name)
    monkeypatch.setattr(ld, name, lambda *given: calls.append(1) or real(*given))
    return calls


def test_small_keys_are_paired_out(spark, monkeypatch):
    """Keys above the pivots but of few lines: all pairs meet there, and no line is asked for by pieces."""
    calls = counted(monkeypatch, "piece_probes")
    same_as_brute_force(spark, template(3, 30))
    assert not calls


@pytest.mark.parametrize("block", [2, 512])
def test_probes_are_made_once_for_pieces_of_few_and_of_many_lines(spark, monkeypatch, block):
    monkeypatch.setattr(ld, "WHOLE_KEY", 5, raising=False)
    monkeypatch.setattr(ld, "BLOCK_LINES", block)
    calls = counted(monkeypatch, "piece_probes")
    same_as_brute_force(spark, template(5, 30))
    assert len(calls) == 1


def test_keys_of_one_line_more_than_are_paired_out(spark, monkeypatch):
    """Keys of the same table on either side of the bound."""
    docs = template(8, 14) + [(100 + k, x.replace("GET /items/", "a line of another kind ")) for k, x in template(9, 40)]
    monkeypatch.setattr(ld, "WHOLE_KEY", 20, raising=False)
    same_as_brute_force(spark, docs)
