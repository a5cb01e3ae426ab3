"""Tool turns of parsed JSON records: calls, replies, definitions, and what they add to keys and sizes.

A record is tooled if it declares tools or functions, or a message has the role tool or function, a call,
a reply id or a name. Everything here is plain Python over one parsed record, in messages that still have
all their fields; a record that is not tooled never comes here.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

#: Fields of a message, and of a record, that belong to tool use. Fixed values.
MESSAGE_FIELDS = ("tool_calls", "function_call", "tool_call_id", "name")
RECORD_FIELDS = ("tools", "functions")
#: A call written into the text of an assistant turn. Fixed value.
TEXT_CALL = re.compile(r"<tool_call>\s*\{.*?\}\s*</tool_call>", re.S)
EITHER = "assistant or user"


def is_tooled(record: dict, messages: list, rejected: list | None) -> bool:
    if any(f in record for f in RECORD_FIELDS):
        return True
    for m in (*messages, *(rejected or ())):
        if isinstance(m, dict) and (m.get("role") in ("tool", "function") or any(f in m for f in MESSAGE_FIELDS) or isinstance(m.get("content"), str) and "<tool_call>" in m["content"]):
            return True
    return False


def calls_tools(message: object) -> bool:
    """Whether a message is an assistant turn that calls a tool."""
    return isinstance(message, dict) and message.get("role") == "assistant" and bool(message.get("tool_calls") or message.get("function_call"))


class _Exchange:
    """The open calls of one conversation, in the order they were made."""

    def __init__(self) -> None:
        self.open: dict[str, tuple[int, object, bool]] = {}  # key: place of the call, function, whether it has an id
        self.closed: set[str] = set()
        self.function: tuple[str, int] | None = None

    def call(self, at: int, message: dict) -> bool:
        """Takes the calls of an assistant turn; whether it made any."""
        made = False
        calls = message.get("tool_calls")
        if isinstance(calls, list) and calls:
            made = True
            for n, c in enumerate(calls):
                if isinstance(c, dict):
                    f = c.get("function")
                    name = f.get("name") if isinstance(f, dict) else None
                    if isinstance(c.get("id"), str):
                        self.open[c["id"]] = (at, name, True)
                    elif c.get("id") is None:
                        self.open[f"#{at}:{n}"] = (at, name, False)
        old = message.get("function_call")
        if isinstance(old, dict):
            made = True
            if isinstance(old.get("name"), str):
                self.function = (old["name"], at)
        return made

    def reply(self, message: dict) -> str | None:
        """Closes the call that a tool turn answers; else the fault."""
        key = message.get("tool_call_id")
        if key is not None:
            if isinstance(key, str) and key in self.open:
                self._close(key)
                return None
            return "call already answered" if isinstance(key, str) and key in self.closed else "reply without a call"
        name = message.get("name")
        key = next((k for k, (_, f, _) in self.open.items() if not isinstance(name, str) or f == name), None)
        if key is None:
            return "reply without a call"
        if self.open[key][2]:
            return "reply without the id of its call"
        self._close(key)
        return None

    def _close(self, key: str) -> None:
        del self.open[key]
        self.closed.add(key)

    def abandoned(self, last: int | None = None) -> Iterator[tuple[int, str]]:
        """Calls that nothing answered; one made by the last message may stand."""
        for at, _, _ in self.open.values():
            if at != last:
                yield at, "call never answered"
        if self.function and self.function[1] != last:
            yield self.function[1], "function call never answered"
        self.open.clear()
        self.function = None


def role_faults(messages: list) -> list[tuple[int, str]]:
    """(place, kind) of the faults in the order of turns, tool exchanges included. A message without a role ends the check."""
    found: list[tuple[int, str]] = []
    exchange, expected, in_text = _Exchange(), "user", False
    for i, m in enumerate(messages):
        if not isinstance(m, dict) or not isinstance(m.get("role"), str):
            return found
        role = m["role"]
        if role == "system":
            if i:
                found.append((i, "late system"))
        elif role == "tool":
            free = m.get("tool_call_id") is None and in_text and not exchange.open
            fault = None if free else exchange.reply(m)
            if fault:
                found.append((i, fault))
            elif not exchange.open:
                expected = EITHER
        elif role == "function":
            if exchange.function and m.get("name") == exchange.function[0]:
                exchange.function, expected = None, EITHER
            else:
                found.append((i, "function reply without a call"))
        else:
            found += exchange.abandoned()
            if role != expected and not (expected == EITHER and role in ("assistant", "user")):
                opening = i == 0 or i == 1 and messages[0]["role"] == "system"
                found.append((i, "first role" if opening else "alternation"))
            expected = "assistant" if role == "user" else "user"
            in_text = role == "assistant" and isinstance(m.get("content"), str) and bool(TEXT_CALL.search(m["content"]))
            if role == "assistant" and exchange.call(i, m):
                expected = "assistant"
    last = len(messages) - 1
    found += exchange.abandoned(last)
    if messages and messages[-1]["role"] != "assistant":
        found.append((last, "ends on other"))
    return found


def _fields(message: object) -> dict:
    return {f: message[f] for f in MESSAGE_FIELDS if f in message} if isinstance(message, dict) else {}


def _quarter(text: str) -> int:
    return -(-len(text) // 4)


def tokens(record: dict, messages: list, rejected: list | None, prompt_len: int | None, overhead: int) -> int:
    """Estimated tokens of the longer side, with calls and definitions."""

    def one(m: object) -> int:
        if not isinstance(m, dict):
            return 0
        role, content, more = m.get("role", ""), m.get("content"), _fields(m)
        text = (content if isinstance(content, str) else "") + (json.dumps(more, ensure_ascii=False) if more else "")
        return _quarter(f"<{role}>\n{text}") + overhead

    sides = [messages] + ([messages[: prompt_len or 0] + rejected] if rejected is not None else [])
    declared = {f: record[f] for f in RECORD_FIELDS if f in record}
    return max(sum(map(one, s)) for s in sides) + (_quarter(json.dumps(declared, ensure_ascii=False)) if declared else 0)


def _key(parts: object) -> str:
    return json.dumps(parts, sort_keys=True, ensure_ascii=False)


def beyond(record: dict, messages: list, rejected: list | None, prompt_len: int | None, overhead: int) -> dict | None:
    """The ``tools`` column of a record; null for one that is not tooled."""
    if not is_tooled(record, messages, rejected):
        return None
    n = prompt_len if prompt_len is not None else next((i + 1 for i in range(len(messages) - 1, -1, -1) if not isinstance(messages[i], dict) or messages[i].get("role") != "assistant"), 0)
    declared = {f: record[f] for f in RECORD_FIELDS if f in record}
    sides = [messages] + ([messages[: prompt_len or 0] + rejected] if rejected is not None else [])
    every = [_fields(m) for m in messages]
    other = [_fields(m) for m in rejected or ()]
    return {
        "roles": [{"idx": i, "kind": kind} for s in sides if s for i, kind in role_faults(s)],
        "calls": [i for i, m in enumerate(messages) if calls_tools(m)],
        "rejected_calls": [i for i, m in enumerate(rejected or ()) if calls_tools(m)],
        "key": _key([every, other, declared]) if any(every) or any(other) or declared else "",
        "prompt_key": _key(every[:n]) if any(every[:n]) else "",
        "tokens": tokens(record, messages, rejected, prompt_len, overhead),
    }


def _json(text: str) -> object:
    def refuse(name: str) -> None:
        raise ValueError(name)

    return json.loads(text, parse_constant=refuse)


def definition_faults(record: dict) -> tuple[list[str], set[str] | None]:
    """Faults of declared tools, and their names; no names where nothing is declared."""
    errors: list[str] = []
    names: set[str] | None = None
    for field in RECORD_FIELDS:
        declared = record.get(field)
        if declared is None:
            continue
        if field == "tools":
            names = set()
        if isinstance(declared, str):
            try:
                declared = _json(declared)
            except (ValueError, RecursionError):
                pass
        if not isinstance(declared, list):
            errors.append(f"{field} are no list")
            continue
        for d in declared:
            f = d
            if field == "tools":
                if not isinstance(d, dict) or d.get("type") != "function":
                    errors.append("a tool is not of type function")
                f = d.get("function") if isinstance(d, dict) else None
            if not isinstance(f, dict) or not isinstance(f.get("name"), str) or not f["name"].strip():
                errors.append("a tool has no name")
                continue
            if names is not None and field == "tools":
                names.add(f["name"])
            if "parameters" in f and not isinstance(f["parameters"], dict):
                errors.append("parameters of a tool are no object")
            if "description" in f and not isinstance(f["description"], str):
                errors.append("the description of a tool is no text")
    return errors, names


def call_faults(messages: list, rejected: list | None, names: set[str] | None) -> list[str]:
    """Faults of the calls of either side; an id may occur once in a record."""
    errors: list[str] = []
    seen: set[str] = set()
    for m in (*messages, *(rejected or ())):
        if not isinstance(m, dict):
            continue
        calls = m.get("tool_calls")
        told = calls is not None
        if told and m.get("role") != "assistant":
            errors.append("only the assistant calls tools")
        if calls == []:
            errors.append("an empty list of calls")
        elif told and not isinstance(calls, list):
            errors.append("calls are no list")
        calls = calls if isinstance(calls, list) else []
        if m.get("function_call") is not None:
            if m.get("role") != "assistant":
                errors.append("only the assistant calls functions")
            calls = [*calls, {"type": "function", "function": m["function_call"]}]
        for c in calls:
            if not isinstance(c, dict):
                errors.append("a call is no object")
                continue
            if told and c.get("id") is not None:
                if not isinstance(c["id"], str) or not c["id"].strip():
                    errors.append("the id of a call is no text")
                elif c["id"] in seen:
                    errors.append("the id of a call repeats")
                else:
                    seen.add(c["id"])
            if c.get("type") != "function":
                errors.append("a call is not of type function")
            f = c.get("function")
            if not isinstance(f, dict):
                errors.append("the function of a call is no object")
                continue
            if not isinstance(f.get("name"), str) or not f["name"].strip():
                errors.append("a call has no function name")
            elif names is not None and f["name"] not in names:
                errors.append("a call of an undeclared tool")
            arguments = f.get("arguments")
            if isinstance(arguments, str):
                try:
                    arguments = _json(arguments)
                except (ValueError, RecursionError):
                    arguments = None
            if not isinstance(arguments, dict):
                errors.append("arguments of a call are no object")
    return errors


def tool_faults(record: dict, messages: list, rejected: list | None) -> list[str]:
    """Faults of definitions and calls. A null field is an absent one."""
    flag = ["parallel_tool_calls is no boolean"] if "parallel_tool_calls" in record and not isinstance(record["parallel_tool_calls"], bool) else []
    errors, names = definition_faults(record)
    return flag + errors + call_faults(messages, rejected, names)
