"""Truncation under a length budget, as array and as length expressions.

``P`` and ``R`` are lengths of prompt and response and ``M`` the most a sample
may have. Functions on ids return new arrays; ``*_lengths`` give the lengths alone,
so that planning needs no ids.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from batchloom.functions.arrays import head, repeat, set_last

Two = tuple[Column, Column]


def instruction_first_lengths(p: Column, r: Column, most: int) -> Two:
    """The response yields first: r = min(R, M - min(P, M/2)); an empty side that is rewritten holds an EOS."""
    over = p + r > most
    new = F.least(r, most - F.least(p, F.lit(most // 2)))
    return F.when(over, F.greatest(most - new, F.lit(1))).otherwise(p), F.when(over, F.greatest(new, F.lit(1))).otherwise(r)


def instruction_first(prompt: Column, response: Column, most: int, eos: int) -> Two:
    """Where P + R > M both sides are cut and end in EOS, even one that wasn't cut; an empty side becomes [eos]."""
    p, r = F.size(prompt), F.size(response)
    new = F.least(r, most - F.least(p, F.lit(most // 2)))
    over = p + r > most
    return F.when(over, set_last(head(prompt, most - new), eos)).otherwise(prompt), F.when(over, set_last(head(response, new), eos)).otherwise(response)


def response_first_lengths(p: Column, r: Column, most: int) -> Two:
    """The prompt yields first: p = min(P, M - min(R, M/2)), r = M - p."""
    over = p + r > most
    new = F.least(p, most - F.least(r, F.lit(most // 2)))
    return F.when(over, new).otherwise(p), F.when(over, F.least(r, most - new)).otherwise(r)


def response_first(prompt: Column, response: Column, most: int, eos: int) -> Two:
    """As the other, with empty sides left empty."""
    p, r = F.size(prompt), F.size(response)
    new, rest = response_first_lengths(p, r, most)
    over = p + r > most

    def cut(ids: Column, n: Column) -> Column:
        short = head(ids, n)
        return F.when(over & (F.size(short) > 0), set_last(short, eos)).otherwise(short)

    return cut(prompt, new), cut(response, rest)


def one_side(ids: Column, budget: Column, eos: int) -> Column:
    """Nothing for a budget of 0 or less; a longer sequence is cut to it and ends in EOS."""
    return F.when(budget <= 0, head(ids, 0)).when(F.size(ids) <= budget, ids).otherwise(set_last(head(ids, budget), eos))


def preference(prompt: Column, chosen: Column, rejected: Column, most: int, eos: int, *, fix_budget: bool = False) -> tuple[Column, Column, Column]:
    """Each side gets M less the prompt, the prompt then a quarter of M without an EOS.

    The budget counts the uncut prompt, so a long prompt empties both sides;
    ``fix_budget`` counts the cut one.
    """
    short = head(prompt, most // 4)
    budget = most - F.size(short if fix_budget else prompt)
    return short, one_side(chosen, budget, eos), one_side(rejected, budget, eos)


def first_ids(ids: Column, most: int) -> Column:
    """The first M ids; an EOS beyond them is lost."""
    return head(ids, most)


def independent(ids: Column, most: int, eos: int) -> tuple[Column, Column]:
    """A side cut to M with an EOS at its end, and whether it was."""
    over = F.size(ids) > most
    return F.when(over, set_last(head(ids, most), eos)).otherwise(ids), over


def trim_lengths(p: Column, r: Column, batch_longest: Column, most: int) -> tuple[Column, Column, Column]:
    """(L, p, r) in a batch whose longest sample has ``batch_longest``: a long prompt may drop the whole response."""
    length = F.least(batch_longest, F.lit(most))
    kept = F.least(p, length)
    return length, kept, F.least(r, length - kept)


def budget_aware(prompt: Column, response: Column, most: int, eos: int, *, keep: str = "tail") -> tuple[Column, Column, Column]:
    """The prompt yields to the response and keeps its ``keep``; (prompt, response, was_cut).

    A response of M or more keeps M - 1 ids, so that a prompt of one EOS fits
    and the sum never exceeds M. An empty prompt stays empty.
    """
    if keep not in ("tail", "head"):
        raise ValueError(f"keep {keep!r}")
    p, r = F.size(prompt), F.size(response)
    over = p + r > most
    room = most - F.when(p > 0, 1).otherwise(0)
    new_response = F.when(over & (r > room), set_last(head(response, room), eos)).otherwise(response)
    budget = most - F.least(r, room)
    n = F.greatest(budget - 1, F.lit(0))
    part = head(prompt, n) if keep == "head" else F.slice(prompt, F.greatest(p - n, F.lit(0)) + 1, n)
    new_prompt = F.when(over & (p > budget), F.concat(part, F.array(F.lit(eos)))).otherwise(prompt)
    return new_prompt, new_response, over


def rollout_prompt(prompt: Column, max_prompt: int, max_gen: int, pad: int) -> Two:
    """(ids, mask): the first ids, padded on the left, with pad for what is to be generated."""
    short = head(prompt, max_prompt)
    left = max_prompt - F.size(short)
    return F.concat(repeat(pad, left), short, repeat(pad, F.lit(max_gen))), F.concat(repeat(0, left), repeat(1, F.size(short)), repeat(0, F.lit(max_gen)))
