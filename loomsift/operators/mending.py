"""The rules and repairs of one record in plain Python, and the loop that repairs it to a fixed point.

Only records that a rule may object to come here, in Arrow batches; the others never leave the JVM. One
kind of repair runs at a time, in the order of ``ORDER``, and all fixable rules look again after each,
since a repair can uncover what another one repairs: text first, then redaction, then what removes or cuts.
"""

from __future__ import annotations

import math

from loomsift.functions import pii, secrets
from loomsift.functions.text import BOM, GARBLED, MESSAGE_OVERHEAD, WHITE_CHARACTERS, repaired_text
from loomsift.schema import ERROR, ROLES, RULES
from loomsift.sources.turns import role_faults

#: Repairs of a record, in the order in which they run.
ORDER = ("encoding", "secrets", "pii", "empty-content", "context-window")
CUTS = 20  # a message is cut to four fifths at most so many times


def _texts(record: dict) -> list[str]:
    return [m["content"] for m in (*(record["messages"] or ()), *(record["rejected"] or ())) if m["content"] is not None]


def _sides(record: dict) -> list[list[dict]]:
    messages, rejected = record["messages"], record["rejected"]
    if messages is None:
        return []
    return [messages] if rejected is None else [messages, messages[: record["prompt_len"] or 0] + rejected]


def _calls(record: dict, side: str) -> frozenset[int]:
    return frozenset((record["tools"] or {}).get(side) or ())


def tokens(record: dict) -> int:
    """Estimated tokens of the longer side, as rules.longest_side has it."""
    if record["tools"] and record["tools"]["tokens"] is not None:
        return record["tools"]["tokens"] - record.get("shortened", 0)
    one = lambda m: math.ceil((len(m["role"] or "") + 3 + len(m["content"] or "")) / 4) + MESSAGE_OVERHEAD
    return max((sum(map(one, s)) for s in _sides(record)), default=0)


def _blank(text: str) -> bool:
    return not text.strip(WHITE_CHARACTERS)


def _encoding(record: dict, _: int) -> bool:
    return any(not t.isascii() and (BOM in t or any(bad in t for bad, _ in GARBLED)) for t in _texts(record))


def _secrets(record: dict, _: int) -> bool:
    return any(map(secrets.find, _texts(record))) or any(f["rule"] == "secrets" for f in record["fields"] or ())


def _pii(record: dict, _: int) -> bool:
    return any(map(pii.find, _texts(record))) or any(f["rule"] == "pii" for f in record["fields"] or ())


def _empty(record: dict, _: int) -> bool:
    blank = lambda side, calls: any(i not in calls and m["content"] is not None and _blank(m["content"]) for i, m in enumerate(record[side] or ()))
    return blank("messages", _calls(record, "calls")) or blank("rejected", _calls(record, "rejected_calls"))


def _long(record: dict, max_seq_len: int) -> bool:
    return record["messages"] is not None and tokens(record) > max_seq_len


FIXABLE = {"encoding": _encoding, "secrets": _secrets, "pii": _pii, "empty-content": _empty, "context-window": _long}


def _schema(record: dict) -> bool:
    if not record["messages"]:
        return True
    faulty = lambda m, called: m["role"] not in ROLES or m["content"] is None and not called
    return any(faulty(m, i in _calls(record, calls)) for side, calls in (("messages", "calls"), ("rejected", "rejected_calls")) for i, m in enumerate(record[side] or ()))


def _roles(record: dict) -> bool:
    if record["tools"]:
        return bool(record["tools"]["roles"])
    return any(side and role_faults(side) for side in _sides(record))


def _preference(record: dict) -> bool:
    plain = lambda turns: [(m["role"], m["content"] and m["content"].strip(WHITE_CHARACTERS)) for m in turns]
    chosen = (record["messages"] or [])[record["prompt_len"] or 0 :]
    return record["rejected"] is not None and bool(chosen) and plain(chosen) == plain(record["rejected"])


UNFIXABLE = {"schema": _schema, "roles": _roles, "preference": _preference}


def errors(record: dict, off: frozenset[str], max_seq_len: int) -> list[str]:
    """Rules whose findings in a record are errors."""
    hard = [n for n, rule in UNFIXABLE.items() if n not in off and rule(record)]
    return hard + [n for n, rule in FIXABLE.items() if n not in off and RULES[n].severity == ERROR and rule(record, max_seq_len)]


def pending(record: dict, off: frozenset[str], max_seq_len: int) -> list[str]:
    """Fixable rules that find something, in the order of their repairs."""
    return [n for n in ORDER if n not in off and FIXABLE[n](record, max_seq_len)]


def _mapped(record: dict, change) -> dict:
    one = lambda turns: turns and [m | {"content": change(m["content"])} if m["content"] is not None else m for m in turns]
    return record | {"messages": one(record["messages"]), "rejected": one(record["rejected"])}


def _without(record: dict, rule: str) -> dict:
    return record | {"fields": [f for f in record["fields"] or () if f["rule"] != rule]}


def _drop_empty(record: dict, _: int) -> dict | None:
    """Without its blank messages; None where a side would be left empty, or where tools are called, whose replies must stay."""
    if record["tools"]:
        return None
    full = lambda m: m["content"] is None or not _blank(m["content"])
    messages, rejected, n = record["messages"], record["rejected"], record["prompt_len"]
    kept = [k for k, m in zip(record["kept"], messages, strict=True) if full(m)]
    left = record | {"messages": list(filter(full, messages)), "rejected": None if rejected is None else list(filter(full, rejected)), "kept": kept}
    left["prompt_len"] = None if n is None else sum(map(full, messages[:n]))
    return left if left["messages"] and (rejected is None or left["rejected"]) else None


def _truncate(record: dict, max_seq_len: int) -> dict | None:
    """The longest user message cut to four fifths until the record fits; None where it never does."""
    record = record | {side: record[side] and [dict(m) for m in record[side]] for side in ("messages", "rejected")}
    for _ in range(CUTS):
        if tokens(record) <= max_seq_len:
            return record
        said = [m for side in ("messages", "rejected") for m in record[side] or () if m["role"] == "user" and m["content"] is not None]
        longest = max(said, key=lambda m: len(m["content"]), default=None)
        if longest is None or len(longest["content"]) <= 1:
            return None
        before = longest["content"]
        longest["content"] = before[: max(1, int(len(before) * 0.8))]
        if record["tools"]:
            record["shortened"] = record.get("shortened", 0) + (len(before) - len(longest["content"])) // 4
    return None


FIXES = {
    "encoding": lambda r, _: _mapped(r, repaired_text),
    "secrets": lambda r, _: _without(_mapped(r, secrets.redact), "secrets"),
    "pii": lambda r, _: _without(_mapped(r, pii.redact), "pii"),
    "empty-content": _drop_empty,
    "context-window": _truncate,
}


def mended(record: dict, off: frozenset[str], max_seq_len: int) -> dict:
    """What becomes of a record: its repaired parts, rules_fixed, rules_unfixable and an error of the repairs themselves.

    ``messages`` is null where the record is lost. Each rule is named once, in the order of its first repair.
    """
    lost = {"messages": None, "rejected": None, "prompt_len": None, "kept": None, "rules_fixed": [], "error": None}
    if hard := [n for n in errors(record, off, max_seq_len) if n not in FIXES] + (["tool-calls"] if record.get("tool_faulty") and "tool-calls" not in off else []):
        return lost | {"rules_unfixable": hard}
    current = record | {"kept": list(range(len(record["messages"] or ())))}
    first = todo = pending(current, off, max_seq_len)
    done: list[str] = []
    for _ in range(len(RULES) + 1):
        if not todo:
            break
        try:
            current = FIXES[todo[0]](current, max_seq_len)
        except Exception as e:  # a repair that fails costs its record and is reported
            return lost | {"rules_unfixable": first, "error": f"{todo[0]}: {type(e).__name__}"}
        if current is None:
            return lost | {"rules_unfixable": first}
        if todo[0] not in done:
            done.append(todo[0])
        todo = pending(current, off, max_seq_len)
    if todo:
        return lost | {"rules_unfixable": first, "error": "repairs did not come to an end"}
    if still := errors(current, off, max_seq_len):
        return lost | {"rules_fixed": done, "rules_unfixable": still}
    return {k: current[k] for k in ("messages", "rejected", "prompt_len", "kept")} | {"rules_fixed": done, "rules_unfixable": [], "error": None}

