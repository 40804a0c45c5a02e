"""Failure codes that this library raises, with what each is about and the names that come with it. Those of native toolchains, jails and command lines that it doesn't have are left out."""

from __future__ import annotations

from stratamill.types import Refusal

#: code, class, whether trying again can help, arguments (fixed values).
FAILURES = """
hpo_walkforward_inventory_invalid request no capability reason
hpo_walkforward_timeframe_unsupported request no capability
"""

CODES = {x[0]: (x[1], x[2] == "yes", tuple(x[3:])) for x in map(str.split, FAILURES.strip().splitlines())}


class Failure(Refusal):
    """A refusal by one of CODES, with exactly its arguments."""

    def __init__(self, code: str, **args):
        if code not in CODES or set(args) != set(CODES[code][2]):
            raise ValueError(f"{code}: {sorted(args)}")
        super().__init__(code, ", ".join(f"{k}={args[k]}" for k in CODES[code][2]), **args)
        self.kind, self.retryable = CODES[code][:2]
