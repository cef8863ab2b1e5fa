"""Rule-driven repair of frontmatter, framed outputs, embeds and vector codes.

Plain Python on one text; ``markdown.column`` makes column functions of them.
"""

from __future__ import annotations

import base64
import json
import re

import numpy as np

from lorekeep.functions.markdown import drop_field, frontmatter_fields, h2_sections, links, set_field, split_frontmatter

DATE = re.compile(r"\d{4}-\d{2}-\d{2}\Z")
URL = re.compile(r"https?://\S+\Z")
TAG = re.compile(r"[\w\-]+(?:/[\w\-]+)*\Z")


def _checked(kind: str, value, rule: dict):
    """The repaired value, or None to drop the field."""
    if kind == "date":
        return value if isinstance(value, str) and DATE.match(value) else None
    if kind == "enum":
        return value if value in rule["values"] else rule.get("default")
    if kind == "url":
        return value if isinstance(value, str) and URL.match(value) else None
    if kind == "string":
        return re.sub(r"\s+", " ", value).strip() or None if isinstance(value, str) else None
    if kind == "number":
        return value if re.fullmatch(r"-?\d+(?:\.\d+)?", str(value)) else None
    if kind == "boolean":
        return value if value in ("true", "false") else None
    entries = [value] if isinstance(value, str) and value else list(value or [])
    if kind == "tags":
        entries = [re.sub(r"[\s_]+", "-", e.strip().lstrip("#").strip("/").lower()) for e in entries]
        entries = [e for e in entries if TAG.match(e)]
    if kind == "urls":
        entries = [e for e in entries if URL.match(e)]
    if kind == "links":
        entries = [(links(e) or [e])[0].rsplit("/", 1)[-1] for e in entries]
    return list(dict.fromkeys(e for e in entries if e))


def repair(content: str, rules: list[dict]) -> tuple[str, list[str]]:
    """Applies ``{field, kind, required?, default?, values?}`` rules: dates, enums,
    URLs, strings, numbers, booleans, and lists of strings, tags, URLs or link
    targets. Values that cannot be repaired fall to the default or go, with a warning each."""
    warnings = []
    for rule in rules:
        name, fields = rule["field"], frontmatter_fields(content)
        if name not in fields:
            if rule.get("required"):
                warnings.append(f"{name}: missing")
                if rule.get("default") is not None:
                    content = set_field(content, name, rule["default"])
            continue
        good = _checked(rule["kind"], fields[name], rule)
        if good == fields[name]:
            continue
        warnings.append(f"{name}: invalid value")
        good = rule.get("default") if good is None else good
        content = drop_field(content, name) if good is None else set_field(content, name, good)
    return content, warnings


def govern(content: str, kind: str, description: str = "", resources: tuple[str, ...] = (), timestamp: str = "", status: str = "") -> str:
    """Fields that the server owns override what the text says; others are kept."""
    for name, value in (("type", kind), ("description", description), ("resource", list(resources)), ("timestamp", timestamp), ("status", status)):
        if value:
            content = set_field(content, name, value)
    return content


def recover(content: str) -> str:
    """Closes a frontmatter that lacks its end, and of repeated fields keeps the last."""
    if not content.startswith("---\n"):
        return content
    head, body = split_frontmatter(content)
    if not head:
        lines = content.split("\n")
        end = next((i for i, x in enumerate(lines[1:], 1) if not re.match(r"[A-Za-z_][\w-]*:|\s+\S|-\s", x)), len(lines))
        head, body = "\n".join([*lines[:end], "---"]), "\n" + "\n".join(lines[end:])
    groups: dict[str, list[str]] = {}
    name = ""
    for line in head.split("\n")[1:-1]:
        if m := re.match(r"([A-Za-z_][\w-]*):", line):
            name = m[1]
            groups.pop(name, None)
        groups.setdefault(name, []).append(line)
    return "---\n" + "\n".join(x for g in groups.values() for x in g) + "\n---" + body


def rename_fields(content: str, names: dict[str, str]) -> str:
    """Renames fields; one that exists under the new name already is left alone."""
    fields = frontmatter_fields(content)
    for old, new in names.items():
        if old in fields and new not in fields:
            content = re.sub(rf"(?m)^{re.escape(old)}:", f"{new}:", content, count=1)
    return content


def relocate_links(content: str, field: str, heading: str) -> str:
    """Moves a list of links from the frontmatter into a body section."""
    from lorekeep.functions.markdown import add_links, list_field

    targets = [(links(e) or [e])[0] for e in list_field(content, field)]
    return add_links(drop_field(content, field), heading, targets) if targets else content


def restore(original: str, formatted: str) -> str:
    """The original's frontmatter before the formatted body."""
    head = split_frontmatter(original)[0]
    return head + split_frontmatter(formatted)[1] if head else formatted


def ensure_tag(content: str, tag: str) -> tuple[str, bool]:
    """Puts a type tag first unless it, or one below it, is there."""
    from lorekeep.functions.markdown import tags_of

    have = tags_of(content)
    if not split_frontmatter(content)[0] or any(t == tag or t.startswith(tag + "/") for t in have):
        return content, False
    return set_field(content, "tags", [tag, *have]), True


def embeds(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"!\[\[([^\]]+)\]\]", text)))


def missing_embeds(original: str, formatted: str) -> list[str]:
    have = embeds(formatted)
    return [e for e in embeds(original) if e not in have]


def restore_embeds(original: str, formatted: str) -> str:
    """Embeds that a rewrite turned into plain links or images get their form back."""
    for e in missing_embeds(original, formatted):
        name = re.escape(e)
        formatted = re.sub(rf"!?\[[^\]]*\]\({name}\)|(?<!!)\[\[{name}\]\]", lambda m, e=e: f"![[{e}]]", formatted)
    return formatted


def frames(text: str, name: str) -> list[str]:
    """Contents between ``<<<name>>>`` and ``<<<end name>>>`` lines."""
    return re.findall(rf"(?ms)^<<<{re.escape(name)}>>>\n(.*?)\n?^<<<end {re.escape(name)}>>>", text)


def framed_json(text: str, name: str) -> str | None:
    for body in frames(text, name):
        try:
            return json.dumps(json.loads(body), ensure_ascii=False, sort_keys=True)
        except ValueError:
            continue
    return None


def encode_vector(vector: list[float]) -> str:
    return base64.b64encode(np.asarray(vector, "<f4").tobytes()).decode()


def decode_vector(code: str) -> list[float]:
    return np.frombuffer(base64.b64decode(code), "<f4").astype(float).tolist()


def segments(source: str, most: int) -> list[dict]:
    """Segments of at most ``most`` characters along sections, then lines, then characters."""
    out: list[str] = []
    for s in h2_sections(source):
        for line in re.findall(r"[^\n]*\n|[^\n]+", s["text"]):
            for piece in [line[i : i + most] for i in range(0, len(line), most)]:
                if out and len(out[-1]) + len(piece) <= most:
                    out[-1] += piece
                else:
                    out.append(piece)
    return [{"ordinal": i, "text": t} for i, t in enumerate(out)]


def managed_lines_blanked(source: str, fields: set[str]) -> str:
    """Blanks managed frontmatter fields and keeps the number of lines."""
    head, body = split_frontmatter(source)
    if not head:
        return source
    out, hide = [], False
    for line in head.split("\n"):
        m = re.match(r"([A-Za-z_][\w-]*):", line)
        hide = m[1] in fields if m else hide and bool(re.match(r"\s+|-\s", line))
        out.append("" if hide else line)
    return "\n".join(out) + body


def evidence_ledger(source: str) -> list[dict]:
    """Code blocks, command lines and URLs of a source with their lines."""
    from lorekeep.functions.markdown import FENCE, scan_lines

    out, block, start = [], [], 0
    for i, line, fenced, _ in scan_lines(source):
        if fenced and FENCE.match(line) and block == []:
            start = i
        if fenced and not FENCE.match(line):
            block.append(line)
        elif block:
            out.append({"kind": "code", "value": "\n".join(block), "start": start, "end": i})
            block = []
        if not fenced:
            if m := re.match(r"\s*[$#>]\s+(\S.*)$", line):
                if line.lstrip()[0] == "$":
                    out.append({"kind": "command", "value": m[1], "start": i, "end": i})
            out += [{"kind": "url", "value": u.rstrip(".,;:"), "start": i, "end": i} for u in re.findall(r"https?://[^\s<>\"')\]]+", line)]
    if block:
        out.append({"kind": "code", "value": "\n".join(block), "start": start, "end": i})
    return out


def missing_evidence(ledger: list[dict], contents: list[str]) -> list[dict]:
    flat = re.sub(r"\s+", " ", "\n".join(contents))
    return [x for x in ledger if re.sub(r"\s+", " ", x["value"]).strip() not in flat]


def with_evidence(content: str, missing: list[dict], heading: str = "Evidence") -> str:
    """Appends missing items under a heading: code in fences, the rest as bullets."""
    if not missing:
        return content
    parts = [f"```\n{x['value']}\n```" if x["kind"] == "code" else f"- `{x['value']}`" if x["kind"] == "command" else f"- {x['value']}" for x in missing]
    return content.rstrip() + f"\n\n## {heading}\n" + "\n".join(parts) + "\n"
