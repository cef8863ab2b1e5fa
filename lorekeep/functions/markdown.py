"""Row-local functions over Markdown: running state across the lines of one text.

They are plain Python on one string, so they are tested as such, and ``column``
turns any of them into an Arrow-batched column function. None looks across rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Rows whose texts are Python objects at once.
ROWS = 64

LINK = re.compile(r"\[\[([^\]|]+?)(?:\|[^\]]+)?\]\]")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")


def _by_slices(f: Callable, kind: pa.DataType, *arrays: pa.Array) -> pa.Array:
    """``f`` on each row; only ``ROWS`` rows at once are Python objects beside the Arrow batch."""
    parts = []
    for i in range(0, len(arrays[0]), ROWS):
        rows = zip(*(a.slice(i, ROWS).to_pylist() for a in arrays))
        parts.append(pa.array([f(*("" if v is None else v for v in row)) for row in rows], kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def column(f: Callable, kind: str | DataType) -> Callable[..., Column]:
    """An Arrow-batched column function of a function on values; null texts are empty."""
    name = kind if isinstance(kind, str) else kind.simpleString()
    arrow = {"string": pa.string(), "array<string>": pa.list_(pa.string())}[name]

    def one(a: pa.Array) -> pa.Array:
        return _by_slices(f, arrow, a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return _by_slices(f, arrow, a, b)

    return F.arrow_udf(one if f.__code__.co_argcount == 1 else two, kind)


def split_frontmatter(content: str) -> tuple[str, str]:
    """(frontmatter with its fences, body); no frontmatter gives an empty first part."""
    if not content.startswith("---\n"):
        return "", content
    close = content.find("\n---", 3)
    if close < 0 or content[close + 4 : close + 5] not in ("", "\n", "\r"):
        return "", content
    return content[: close + 4], content[close + 4 :]


def frontmatter_fields(content: str) -> dict[str, str | list[str]]:
    """Top-level scalars and lists of strings; nested values are left out."""
    head = split_frontmatter(content)[0]
    out: dict[str, str | list[str]] = {}
    name = None
    for line in head.split("\n")[1:-1]:
        if m := re.match(r"^([A-Za-z_][\w-]*):[ \t]*(.*)$", line):
            name, value = m[1], m[2].strip()
            if value.startswith("[") and value.endswith("]"):
                out[name] = [unquoted(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\[\]]+", value[1:-1]) if x.strip()]
            else:
                out[name] = unquoted(value)
        elif name and (m := re.match(r"^\s*-[ \t]+(.*)$", line)):
            if not isinstance(out.get(name), list):
                out[name] = []
            out[name].append(unquoted(m[1]))
    return out


def unquoted(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def list_field(content: str, name: str) -> list[str]:
    value = frontmatter_fields(content).get(name, [])
    return value if isinstance(value, list) else [value] if value and name == "aliases" else []


def tags_of(content: str) -> list[str]:
    return list_field(content, "tags")


def aliases_of(content: str) -> list[str]:
    return [a for a in list_field(content, "aliases") if a.strip()]


def resources_of(content: str) -> list[str]:
    return list_field(content, "resource")


def description_of(content: str) -> str:
    value = frontmatter_fields(content).get("description", "")
    return value if isinstance(value, str) else ""


def set_field(content: str, name: str, value: str | list[str]) -> str:
    """Replaces or adds one top-level field; a page without frontmatter gets one."""
    text = f"{name}:" + "".join(f"\n  - {json.dumps(v, ensure_ascii=False)}" for v in value) if isinstance(value, list) else f"{name}: {json.dumps(value, ensure_ascii=False)}"
    head, body = split_frontmatter(content)
    if not head:
        return f"---\n{text}\n---\n{content}"
    lines, out, skip, done = head.split("\n")[1:-1], [], False, False
    for line in lines:
        if re.match(rf"^{re.escape(name)}:", line):
            skip = True
            if not done:
                out.append(text)
                done = True
            continue
        if skip and re.match(r"^\s+|^-", line):
            continue
        skip = False
        out.append(line)
    if not done:
        out.append(text)
    return "---\n" + "\n".join(out) + "\n---" + body


def drop_field(content: str, name: str) -> str:
    head, body = split_frontmatter(content)
    if not head:
        return content
    return "---\n" + re.sub(rf"(?m)^{re.escape(name)}:.*\n(?:[ \t]+.*\n|-.*\n)*", "", head[4:]) + body


def ensure_field(content: str, name: str, value: str | list[str]) -> str:
    """Sets a field only where it is absent or empty."""
    return content if frontmatter_fields(content).get(name) else set_field(content, name, value)


def kept_entries(content: str, name: str, known: set[str]) -> tuple[str, list[str]]:
    """The list field with only known entries, and a warning for every other."""
    entries = list_field(content, name)
    good = [e for e in entries if e in known]
    if len(good) == len(entries):
        return content, []
    return set_field(content, name, good), [f"{name}: removed {e}" for e in entries if e not in known]


def scan_lines(text: str) -> list[tuple[int, str, bool, list[str]]]:
    """(number, line, inside a code fence, heading path) of each line from 1."""
    out, fence, path = [], "", []
    for i, line in enumerate(text.split("\n"), 1):
        m = FENCE.match(line)
        if fence:
            out.append((i, line, True, list(path)))
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
            continue
        if m and not (m[1][0] == "`" and "`" in m[2]):
            fence = m[1]
            out.append((i, line, True, list(path)))
            continue
        if h := HEADING.match(line):
            path = [*path[: len(h[1]) - 1], h[2]]
        out.append((i, line, False, list(path)))
    return out


def sections(text: str) -> list[dict]:
    """Sections by heading with their line ranges; a lead without a heading is one."""
    out: list[dict] = []
    for i, line, fenced, path in scan_lines(text):
        if not out or (not fenced and HEADING.match(line)):
            out.append({"heading_path": path, "start": i, "end": i, "text": line})
        else:
            out[-1]["end"], out[-1]["text"] = i, out[-1]["text"] + "\n" + line
    return out


def h2_sections(text: str) -> list[dict]:
    """Spans from each second-level heading to the next; together with the lead
    they are the text again."""
    out: list[dict] = [{"heading": "", "text": ""}]
    lines = text.split("\n")
    for k, (_, line, fenced, _) in enumerate(scan_lines(text)):
        piece = line + ("\n" if k < len(lines) - 1 else "")
        if not fenced and re.match(r"^## +\S", line):
            out.append({"heading": line[3:].strip(), "text": piece})
        else:
            out[-1]["text"] += piece
    return [s for s in out if s["text"]]


def chunk_source(text: str, budget: int, cost: Callable[[str], float] = len, overlap: int = 0) -> list[dict]:
    """Chunks under a budget: the whole, else sections, else paragraphs, else
    windows of lines that overlap; blank-only pieces join a neighbour. Every line is covered."""
    lines = text.split("\n")

    def piece(a: int, b: int) -> str:
        return "\n".join(lines[a - 1 : b])

    def windows(a: int, b: int):
        while a <= b:
            end = a
            while end < b and cost(piece(a, end + 1)) <= budget:
                end += 1
            yield a, end
            a = max(a + 1, end + 1 - overlap) if end < b else b + 1

    def paragraphs(a: int, b: int):
        scanned, start = scan_lines(text), a
        for i in range(a, b):
            if not lines[i - 1].strip() and lines[i].strip() and not scanned[i][2]:
                yield start, i
                start = i + 1
        yield start, b

    def split(ranges, parts):
        for a, b in ranges:
            if cost(piece(a, b)) <= budget:
                yield a, b
            else:
                yield from parts(a, b)

    ranges = [(1, len(lines))]
    own = sections(text)
    ranges = list(split(ranges, lambda a, b: ((s["start"], s["end"]) for s in own)))
    ranges = list(split(split(ranges, paragraphs), windows))
    merged: list[tuple[int, int]] = []
    for a, b in ranges:
        joined = merged and cost(piece(merged[-1][0], b)) <= budget
        if merged and joined and (not piece(a, b).strip() or not piece(*merged[-1]).strip()):
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    paths = {i: p for i, _, _, p in scan_lines(text)}
    return [{"ordinal": k, "start": a, "end": b, "heading_path": paths[a], "text": piece(a, b)} for k, (a, b) in enumerate(merged)]


def uncovered_lines(text: str, chunks: list[dict]) -> list[int]:
    have = {i for c in chunks for i in range(c["start"], c["end"] + 1)}
    return [i for i in range(1, text.count("\n") + 2) if i not in have]


def split_units(body: str, least: int, most: int, overlap: int, excluded: tuple[str, ...] = ("related", "external links"), cap: int = 0) -> list[dict]:
    """Second-level units without excluded sections; a short one joins the unit
    before, long ones become overlapping windows, and beyond ``cap`` the rest joins the last."""
    units = [s for s in h2_sections(body) if s["heading"].lower() not in excluded and s["text"].strip()]
    joined: list[dict] = []
    for u in units:
        if joined and len(u["text"].strip()) < least and joined[-1]["heading"]:
            joined[-1] = {"heading": joined[-1]["heading"], "text": joined[-1]["text"].rstrip() + "\n\n" + u["text"]}
        else:
            joined.append(dict(u))
    out = []
    for u in joined:
        t, at = u["text"].strip(), 0
        while True:
            out.append({"heading": u["heading"], "text": t[at : at + most]})
            if at + most >= len(t):
                break
            at += max(1, most - overlap)
    if cap and len(out) > cap:
        out[cap - 1] = {"heading": out[cap - 1]["heading"], "text": "\n\n".join(x["text"] for x in out[cap - 1 :])}
        out = out[:cap]
    return out


def outside_code(text: str, f: Callable[[str], str]) -> str:
    """Applies ``f`` to what stands outside fences and inline code."""
    out, plain = [], []

    def flush():
        if plain:
            out.append("".join(p if i % 2 else f(p) for i, p in enumerate(re.split(r"(`+[^`\n]*`+)", "\n".join(plain)))))
            plain.clear()

    for _, line, fenced, _ in scan_lines(text):
        if fenced:
            flush()
            out.append(line)
        else:
            plain.append(line)
    flush()
    return "\n".join(out)


def answer_links(text: str) -> list[str]:
    found: list[str] = []
    outside_code(text, lambda t: found.extend(m.strip() for m in LINK.findall(t)) or t)
    return list(dict.fromkeys(found))


def links(text: str) -> list[str]:
    return [m.strip() for m in LINK.findall(text)]


def link_violations(text: str) -> list[dict]:
    """Links with an alias, and links with a path."""
    alias = [{"kind": "alias", "detail": m[0]} for m in re.finditer(r"\[\[([^\]|]+)\|([^\]]+)\]\]", text)]
    return alias + [{"kind": "path", "detail": m[0]} for m in re.finditer(r"\[\[([^\]|]+)\]\]", text) if "/" in m[1]]


def fix_links(content: str) -> str:
    """Aliases dropped and paths reduced to names, in the body only."""
    head, body = split_frontmatter(content)
    body = re.sub(r"\[\[([^\]|]+)\|[^\]]+\]\]", r"[[\1]]", body)
    return head + re.sub(r"\[\[([^\]|]+)\]\]", lambda m: f"[[{m[1].rsplit('/', 1)[-1]}]]", body)


def strip_dead_links(content: str, known: set[str]) -> str:
    """Removes body links to unknown targets and what they leave behind: doubled
    spaces and bullets without text."""
    head, body = split_frontmatter(content)
    out = []
    for line in body.split("\n"):
        fresh = LINK.sub(lambda m: m[0] if m[1].strip() in known else "", line)
        if fresh != line:
            fresh = re.sub(r"[ \t]{2,}", " ", fresh).rstrip()
            if re.fullmatch(r"\s*[-*+]?[ \t]*[,;:.]*", fresh):
                continue
        out.append(fresh)
    return head + "\n".join(out)


def annotate_broken(text: str, broken: set[str]) -> str:
    return outside_code(text, lambda t: LINK.sub(lambda m: m[0] + " (missing)" if m[1].strip() in broken else m[0], t))


def replace_link(text: str, old: str, new: str) -> str:
    return outside_code(text, lambda t: re.sub(rf"\[\[{re.escape(old)}(\|[^\]]+)?\]\]", lambda m: f"[[{new}{m[1] or ''}]]", t))


def to_markdown_links(body: str, paths: dict[str, str]) -> tuple[str, list[str]]:
    """Wiki links as Markdown links by a table of paths; unknown ones become plain text."""
    dead: list[str] = []

    def one(m: re.Match) -> str:
        target, _, label = m[1].partition("|")
        name = target.strip().split("#")[0]
        if name in paths:
            return f"[{label.strip() or name}]({paths[name]})"
        dead.append(name)
        return label.strip() or name

    return re.sub(r"\[\[([^\]]+)\]\]", one, body), list(dict.fromkeys(dead))


def title_of(content: str, fallback: str) -> str:
    m = re.search(r"(?m)^#\s+(.+)$", split_frontmatter(content)[1])
    return m[1].strip() if m else fallback


def fallback_description(content: str, kind: str = "", most: int = 800) -> str:
    """First heading and sentence of a page, with its type."""
    body = split_frontmatter(content)[1]
    title = title_of(content, "")
    prose = next((p.strip() for p in re.split(r"\n\s*\n", re.sub(r"(?m)^#.*$", "", body)) if p.strip()), "")
    sentence = re.split(r"(?<=[.!?])\s", re.sub(r"\s+", " ", LINK.sub(r"\1", prose)))[0]
    return ". ".join(x for x in (title, sentence, kind) if x)[:most]


def merge_sections(merged: str, incoming: str) -> str:
    """Appends second-level sections whose headings the merged page lacks."""
    key = lambda h: re.sub(r"\s+", " ", h).strip().lower()
    have = {key(s["heading"]) for s in h2_sections(merged)}
    extra = [s["text"].rstrip() for s in h2_sections(incoming) if s["heading"] and key(s["heading"]) not in have]
    return "\n\n".join([merged.rstrip(), *extra]) + "\n" if extra else merged


def remove_sections(content: str, names: set[str]) -> str:
    return "".join(s["text"] for s in h2_sections(content) if s["heading"].lower() not in names)


def section_links(content: str, names: set[str]) -> list[str]:
    return list(dict.fromkeys(x for s in h2_sections(content) if s["heading"].lower() in names for x in links(s["text"])))


def add_links(content: str, heading: str, targets: list[str]) -> str:
    """Union of links into a section, which is added at the end where absent."""
    parts = h2_sections(content)
    own = next((s for s in parts if s["heading"].lower() == heading.lower()), None)
    fresh = [t for t in dict.fromkeys(targets) if t not in (links(own["text"]) if own else [])]
    if not fresh:
        return content
    bullets = "\n".join(f"- [[{t}]]" for t in fresh)
    if own is None:
        return content.rstrip() + f"\n\n## {heading}\n{bullets}\n"
    own["text"] = own["text"].rstrip() + "\n" + bullets + "\n"
    return "".join(s["text"] for s in parts)


def apply_patch(page: str, patches: list[dict], page_hash: str | None = None, hash_: Callable[[str], str] = str) -> tuple[str, list[str]]:
    """Section patches ``{action: add|append|replace, heading, body, hash?}``; a
    page or section that has changed since, or an unknown or doubled heading, is a problem and leaves the page as it is."""
    if page_hash is not None and hash_(page) != page_hash:
        return page, ["stale page"]
    parts, problems = h2_sections(page), []
    for p in patches:
        own = [s for s in parts if s["heading"].lower() == p["heading"].lower()]
        text = f"## {p['heading']}\n{p['body'].rstrip()}\n"
        if p["action"] == "add":
            if own:
                problems.append(f"section exists: {p['heading']}")
            else:
                if parts:
                    parts[-1]["text"] = parts[-1]["text"].rstrip("\n") + "\n\n"
                parts.append({"heading": p["heading"], "text": text})
        elif len(own) != 1:
            problems.append(f"{'unknown' if not own else 'duplicate'} section: {p['heading']}")
        elif p.get("hash") is not None and hash_(own[0]["text"]) != p["hash"]:
            problems.append(f"stale section: {p['heading']}")
        elif p["action"] == "append":
            own[0]["text"] = own[0]["text"].rstrip("\n") + "\n" + p["body"].rstrip() + "\n"
        else:
            own[0]["text"] = text
    return (page, problems) if problems else ("".join(s["text"] for s in parts), [])


def technical_units(markdown: str) -> list[dict]:
    """Typed technical units of a text, each kind masked before the next is looked
    for: fenced and inline code, URLs, IPv4, UUIDs, paths, assignments, flags, numbers."""
    out: list[dict] = []
    rest = []
    block: list[str] = []
    for _, line, fenced, _ in scan_lines(markdown):
        if fenced:
            if not FENCE.match(line):
                block.append(line)
            continue
        if block:
            out.append({"kind": "fenced", "value": "\n".join(block)})
            block = []
        rest.append(line)
    if block:
        out.append({"kind": "fenced", "value": "\n".join(block)})
    text = "\n".join(rest)
    kinds = [
        ("inline", r"`+([^`\n]+)`+"),
        ("url", r"https?://[^\s<>\"')\]]+"),
        ("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b"),
        ("uuid", r"\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b"),
        ("path", r"(?<![\w/])(?:~|\.{1,2})?/(?:[\w.\-]+/)*[\w.\-]+"),
        ("assignment", r"\b[A-Za-z_][\w.]*=[^\s,;]+"),
        ("flag", r"(?<!\w)--?[A-Za-z][\w\-]*"),
        ("number", r"(?<![\w.])\d+(?:[.,]\d+)*(?:\s?(?:KB|MB|GB|TB|ms|s|%))?(?!\w)"),
    ]
    for kind, pattern in kinds:
        for m in re.finditer(pattern, text):
            out.append({"kind": kind, "value": (m[1] if m.groups() else m[0]).rstrip(".,;:")})
        text = re.sub(pattern, lambda m: " " * len(m[0]), text)
    return [dict(t) for t in dict.fromkeys(tuple(u.items()) for u in out)]


def unsupported_units(answer: str, context: list[str], ids: list[str] = ()) -> list[dict]:
    """Units of an answer that no context contains; numbers must stand alone there."""
    flat = "\n".join(context)

    def supported(u: dict) -> bool:
        if u["value"] in ids:
            return True
        if u["kind"] == "number":
            return re.search(rf"(?<![\w.]){re.escape(u['value'])}(?![\w])", flat) is not None
        return u["value"] in flat

    return [u for u in technical_units(answer) if not supported(u)]


def sanitise_answer(answer: str, unsupported: list[dict]) -> str:
    """Drops unsupported inline and plain units and lines that then say nothing."""
    out = []
    for line in answer.split("\n"):
        fresh = line
        for u in sorted(unsupported, key=lambda u: -len(u["value"])):
            fresh = fresh.replace(f"`{u['value']}`", "").replace(u["value"], "")
        if fresh != line:
            fresh = re.sub(r"[ \t]{2,}", " ", fresh).rstrip()
            if not re.search(r"\w", fresh):
                continue
        out.append(fresh)
    return "\n".join(out)


def significant_tokens(text: str) -> list[str]:
    """URLs, numbers, capitalised names, acronyms and identifiers, distinct."""
    pattern = r"https?://[^\s<>\"')\]]+|\b\d+(?:[.,]\d+)*\b|\b[A-Z]{2,}\b|\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b|\b[a-z]+(?:_[a-z0-9]+)+\b|\b[A-ZÀ-ÞА-Я][a-zß-ÿа-я]{2,}\b"
    return list(dict.fromkeys(m.rstrip(".,;:") for m in re.findall(pattern, text)))


def missing_tokens(original: str, formatted: str) -> list[dict]:
    """Significant tokens lost in a rewrite, plurals alike, with their first line."""
    stem = lambda t: t.lower().removesuffix("s")
    have = {stem(t) for t in re.findall(r"[^\s]+", re.sub(r"[^\w./:\-]+", " ", formatted))} | {stem(t) for t in significant_tokens(formatted)}
    lines = original.split("\n")
    return [{"token": t, "line": next(x for x in lines if t in x)} for t in significant_tokens(original) if stem(t) not in have]


def append_missing(formatted: str, missing: list[dict]) -> str:
    lines = list(dict.fromkeys(m["line"].strip() for m in missing))
    return formatted if not lines else formatted.rstrip() + "\n\n" + "\n".join(lines) + "\n"


def looks_truncated(text: str) -> bool:
    """Whether JSON ends inside a string or with open brackets."""
    depth, inside, escaped = 0, False, False
    for c in text:
        if inside:
            inside, escaped = (c != '"' or escaped), c == "\\" and not escaped
        elif c == '"':
            inside = True
        else:
            depth += (c in "{[") - (c in "}]")
    return inside or depth > 0


def tolerant_json(text: str) -> str | None:
    """The first JSON object in a text, with or without fences, normalised."""
    text = re.sub(r"<think>.*?</think>", "", text, flags=re.S)
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            return json.dumps(decoder.raw_decode(text[m.start() :])[0], ensure_ascii=False, sort_keys=True)
        except ValueError:
            continue
    return None


def render_template(template: str, values: dict[str, str]) -> str:
    return re.sub(r"\{\{(\w+)\}\}", lambda m: values.get(m[1], m[0]), template)
