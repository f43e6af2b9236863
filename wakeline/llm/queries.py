"""Queries of the training-data operators and their SQL where it exists."""

from __future__ import annotations

from wakeline.llm import abuse, leaks, survivor, tokens


def queries() -> dict:
    return {
        "p7_found": survivor.p7_found,
        "p7_survivors": survivor.p7_survivors,
        "p8_ids": tokens.p8_ids,
        "p9_found": leaks.p9_found,
        "p10_found": abuse.p10_found,
        "p10_rates": abuse.p10_rates,
    }


def oracle_sql() -> dict:
    return {"p7_found": survivor.P7_SQL, "p7_survivors": survivor.P7_SURVIVORS_SQL}
