from lorekeep.functions import frontmatter as R
from lorekeep.functions import markdown as M

PAGE = "---\ncreated: 2024-13\nstatus: odd\ntags: [ A b, '#x/y']\nlink: ftp://x\nresource:\n  - '[[p/q]]'\n---\nbody\n"
RULES = [
    {"field": "created", "kind": "date", "default": "2024-01-01"},
    {"field": "status", "kind": "enum", "values": ["new", "done"], "default": "new"},
    {"field": "tags", "kind": "tags"},
    {"field": "link", "kind": "url"},
    {"field": "resource", "kind": "links"},
    {"field": "type", "kind": "string", "required": True, "default": "concept"},
]


def test_repair():
    fixed, warnings = R.repair(PAGE, RULES)
    f = M.frontmatter_fields(fixed)
    assert f == {"created": "2024-01-01", "status": "new", "tags": ["a-b", "x/y"], "resource": ["q"], "type": "concept"}
    assert len(warnings) == 6 and R.repair(fixed, RULES) == (fixed, [])
    assert M.split_frontmatter(fixed)[1] == "\nbody\n"


def test_govern_recover_rename():
    assert M.frontmatter_fields(R.govern(PAGE, "t", "d", ("a",)))["type"] == "t"
    assert M.frontmatter_fields(R.recover("---\na: 1\nb: 2\na: 3\ntext\n")) == {"b": "2", "a": "3"}
    assert "state: odd" in R.rename_fields(PAGE, {"status": "state"}) and R.restore(PAGE, "---\nz: 1\n---\nnew") == PAGE[: PAGE.index("\nbody")] + "\nnew"
    assert R.ensure_tag(PAGE, "t")[1] and not R.ensure_tag(R.ensure_tag(PAGE, "t")[0], "t")[1]
    moved = R.relocate_links(PAGE, "resource", "Related")
    assert M.resources_of(moved) == [] and M.links(moved) == ["p/q"]


def test_embeds_frames_vectors():
    assert R.missing_embeds("![[a.png]] ![[b]]", "![[b]]") == ["a.png"] and R.restore_embeds("![[a.png]]", "x [[a.png]] ![p](a.png)") == "x ![[a.png]] ![[a.png]]"
    text = "<<<x>>>\nbad\n<<<end x>>>\n<<<x>>>\n{\"b\": 1}\n<<<end x>>>"
    assert R.frames(text, "x") == ["bad", '{"b": 1}'] and R.framed_json(text, "x") == '{"b": 1}'
    assert R.decode_vector(R.encode_vector([1.5, -2.0])) == [1.5, -2.0]
    cut = R.segments("a\n" * 30 + "## h\n" + "b" * 50, 20)
    assert "".join(s["text"] for s in cut) == "a\n" * 30 + "## h\n" + "b" * 50 and all(len(s["text"]) <= 20 for s in cut)


def test_evidence():
    source = "---\nresource:\n  - a\nx: 1\n---\nrun:\n$ ls -l\n```\ncode\nmore\n```\nsee http://a.io/x.\n"
    assert R.managed_lines_blanked(source, {"resource"}).split("\n")[:5] == ["---", "", "", "x: 1", "---"]
    ledger = R.evidence_ledger(source)
    assert [(x["kind"], x["value"], x["start"], x["end"]) for x in ledger] == [("command", "ls -l", 7, 7), ("code", "code\nmore", 8, 11), ("url", "http://a.io/x", 12, 12)]
    missing = R.missing_evidence(ledger, ["ls -l and code more"])
    assert [x["kind"] for x in missing] == ["url"] and "## Evidence" in R.with_evidence("x", missing)
