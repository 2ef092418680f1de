import gzip
import json

from layerlake.sources import files


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_text(spark, tmp_path):
    write(tmp_path / "a" / "2025-01-15-meeting_notes.md", '---\ntitle: "On: it"\ntags: [x, "y z"]\n# c\n---\nUser: hi\n\nAssistant: yes you\n')
    write(tmp_path / "2024-02-03-plain notes!.txt", "  just words here \n")
    write(tmp_path / "empty.md", "---\ntitle: t\n---\n \n")
    rows = {r.label: r for r in files.read_text(spark, str(tmp_path)).collect()}
    assert set(rows) == {"t-text-2025-01-15-meeting_notes", "t-text-2024-02-03-plain-notes"}
    a, b = rows["t-text-2025-01-15-meeting_notes"], rows["t-text-2024-02-03-plain-notes"]
    assert (a.title, a.date, a.tags, a.message_count, a.word_count) == ("On: it", "2025-01-15", ["x", "y z"], 2, 5)
    assert a.content == "User: hi\n\nAssistant: yes you\n"
    assert (b.title, b.date, b.tags, b.content, b.message_count) == ("Plain Notes!", "2024-02-03", [], "just words here\n", 0)
    paths = {r.source_path for r in files.files(spark, str(tmp_path), "*.md", exclude="empty").collect()}
    assert paths == {"a/2025-01-15-meeting_notes.md"}


def msg(role, *parts, at=None):
    return {"author": {"role": role}, "content": {"parts": list(parts)}, "create_time": at}


def test_exports(spark, tmp_path):
    tree = {
        "r": {"parent": None, "children": ["q"], "message": None},
        "q": {"parent": "r", "children": ["a1", "a2"], "message": msg("user", "ask", {"image": 1}, at=1700000000)},
        "a1": {"parent": "q", "children": [], "message": msg("assistant", "old", at=1700000100)},
        "a2": {"parent": "q", "children": ["t"], "message": msg("assistant", "ne", "w", at=1700090000)},
        "t": {"parent": "a2", "children": [], "message": msg("tool", "noise")},
    }
    convs = [
        {"conversation_id": "c1", "title": "T", "create_time": 1700000000, "current_node": "t", "mapping": tree, "customer_id": "k"},
        {"id": "c2", "create_time": 0, "mapping": tree},
        {"id": "c3", "mapping": {}},
    ]
    write(tmp_path / "tree.json", json.dumps(convs))
    flat = {"conversations": [
        {"uuid": "u1", "name": "N", "created_at": "2025-03-01T23:00:00Z", "chat_messages": [
            {"sender": "human", "text": "q", "created_at": "2025-03-02T00:00:00Z"},
            {"sender": "assistant", "content": [{"type": "text", "text": "a"}, "b"]},
            {"sender": "assistant", "text": " "}]},
        {"uuid": "u2", "chat_messages": []}]}
    write(tmp_path / "flat.json", json.dumps(flat))
    write(tmp_path / "bad.json", "{no")
    exports = files.read_exports(spark, str(tmp_path))
    rows = {r.label: r for r in files.tree_chats(exports).collect()}
    assert set(rows) == {"t-chatgpt-c1", "t-chatgpt-c2"}
    c1, c2 = rows["t-chatgpt-c1"], rows["t-chatgpt-c2"]
    assert c1.content == "user: ask\n\nassistant: new\n" and c2.content == "user: ask\n\nassistant: old\n"
    assert (c1.date, c1.last_message_date, c1.message_count, c1.customer_id) == ("2023-11-14", "2023-11-15", 2, "k")
    assert (c2.title, c2.date) == ("Untitled", "")
    (f,) = files.flat_chats(exports).collect()
    assert (f.label, f.content, f.date, f.last_message_date, f.message_count) == ("t-claude-u1", "user: q\n\nassistant: a b\n", "2025-03-01", "2025-03-02", 3)
    assert [r.path.rsplit("/", 1)[1] for r in files.malformed(exports).collect()] == ["bad.json"]


def test_line_sessions(spark, tmp_path):
    def entry(kind, content, **more):
        return json.dumps({"type": kind, "message": {"role": kind, "content": content}, **more})

    lines = [
        entry("user", " hello ", timestamp="2025-05-05T10:00:00Z", cwd=""), "{broken", json.dumps({"type": "summary"}), "3",
        entry("assistant", [{"type": "thinking", "text": "x"}, {"type": "text", "text": "one"}, {"type": "text", "text": " two"}], slug="s", cwd="/w"),
        entry("user", [{"type": "tool_result"}]),
    ]
    write(tmp_path / "p" / "s1.jsonl", "\n".join(lines) + "\n")
    write(tmp_path / "p" / "s2.jsonl", lines[0])
    with gzip.open(tmp_path / "z.jsonl.gz", "wt") as f:
        f.write("\n".join(lines) + "\n")
    (r,) = files.read_sessions(spark, str(tmp_path)).collect()
    assert r.content == "User: hello\n\nAssistant: one\n\ntwo" and r.message_count == 2
    assert (r.title, r.date, r.cwd, r.git_branch) == ("s", "2025-05-05", "/w", "")
    write(tmp_path / "n.md", "words")
    labels = {x.label for x in files.read_all(spark, str(tmp_path), {k: files.READERS[k] for k in ("text", "lines")}).collect()}
    assert labels == {r.label, "t-text-n"}
