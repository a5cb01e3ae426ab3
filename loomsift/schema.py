"""Severities, roles and the rule catalogue."""

from __future__ import annotations

from typing import NamedTuple

ERROR, WARNING, INFO = "error", "warning", "info"
SEVERITY_RANK = {ERROR: 0, WARNING: 1, INFO: 2}
ROLES = ("assistant", "function", "system", "tool", "user")
MAX_SEQ_LEN = 4096
#: The one fault of tool calls that is a warning.
EMPTY_CALLS = "an empty list of calls"


class RuleInfo(NamedTuple):
    order: int
    id: str
    severity: str
    fixable: bool
    scope: str
    description: str


#: In the order in which findings of one record are reported.
RULES = {
    r.id: r
    for r in (
        RuleInfo(0, "tool-calls", ERROR, False, "record", "tool definitions and calls are well formed and declared"),
        RuleInfo(1, "schema", ERROR, False, "record", "records have messages with known roles and text"),
        RuleInfo(2, "roles", ERROR, False, "record", "turns alternate and end on the assistant"),
        RuleInfo(3, "empty-content", ERROR, True, "record", "no message is empty"),
        RuleInfo(4, "context-window", WARNING, True, "record", "records fit the context window"),
        RuleInfo(5, "duplicates", ERROR, True, "dataset", "no record repeats an earlier one"),
        RuleInfo(6, "encoding", WARNING, True, "record", "no byte order marks or common garbled sequences"),
        RuleInfo(7, "preference", ERROR, False, "record", "both sides of a pair differ"),
        RuleInfo(8, "secrets", ERROR, True, "record", "no credentials"),
        RuleInfo(9, "pii", WARNING, True, "record", "no e-mail addresses, phone numbers or payment cards"),
        RuleInfo(10, "eval-overlap", ERROR, True, "dataset", "no record also stands in the evaluation set"),
    )
}


def disabled_rules(names: list[str] | None) -> set[str]:
    """The rules to leave out; an unknown name, or schema, is an error."""
    out = set(names or ())
    if unknown := out - RULES.keys():
        raise ValueError(f"unknown rules: {', '.join(sorted(unknown))}")
    if "schema" in out:
        raise ValueError("schema cannot be left out")
    return out
