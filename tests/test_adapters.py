from __future__ import annotations

import io
import json
import sys

import pytest

from gleaner import cli
from gleaner.streaming import hook


@pytest.fixture()
def code(tmp_path):
    path = tmp_path / "module.py"
    path.write_text("def find_me(x):\n    return x\n\n\ndef other():\n    pass\n")
    return path


def test_exit_codes(spark, code, capsys):
    assert cli.main([str(code), "find_me"], spark) == 0
    assert "find_me" in capsys.readouterr().out
    assert cli.main([str(code), "absent_name"], spark) == 1
    assert cli.main([str(code.parent / "none.py"), "x"], spark) == 1
    assert cli.main([str(code), "(a+)+"], spark) == 2


def test_json_and_budget(spark, code, capsys):
    assert cli.main([str(code), "find_me", "1", "1", "--json", "--budget", "50"], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["budget"] == 50 and out["chunks"][0]["symbol"] is None
    assert "budget" in cli.focused_read_tool(str(code), "find_me", spark=spark)


@pytest.fixture()
def large(tmp_path, monkeypatch):
    monkeypatch.setattr(hook.tempfile, "gettempdir", lambda: str(tmp_path))
    path = tmp_path / "large_file.py"
    path.write_text("".join(f"class Thing{i}:\n    def work_{i}(self):\n        return {i}\n\n" for i in range(400)))
    return path


def request(path, **more):
    return {"tool_name": "Read", "session_id": "s/1", "tool_input": {"file_path": str(path), **more}}


def test_first_read_is_replaced_and_the_second_passes(spark, large, tmp_path):
    (tmp_path / "t.jsonl").write_text(json.dumps({"message": {"role": "user", "content": "look at work_7 please"}}) + "\n")
    answer = hook.decide(request(large) | {"transcript_path": str(tmp_path / "t.jsonl")}, spark)
    assert answer["decision"] == "replace" and "FILE MAP" in answer["context"] and "work_7" in answer["context"]
    assert hook.decide(request(large), spark) is None


def test_what_passes_through(spark, large, code, tmp_path):
    (tmp_path / "prose.md").write_text("word " * 9000)
    for r in (request(code), request(large, offset=3), request(tmp_path / "prose.md"), request(tmp_path / "no.py"), request(large) | {"tool_name": "Grep"}, {}):
        assert hook.decide(r, spark) is None


def test_failures_are_silent(spark, monkeypatch, capsys):
    monkeypatch.setattr(sys, "stdin", type("S", (), {"buffer": io.BytesIO(b"\xef\xbb\xbfnot json")})())
    assert hook.main(spark) == 0 and capsys.readouterr().out == ""


def test_newest_user_words_weigh_most(tmp_path):
    rows = [("user", "about older_name"), ("assistant", "middle_name"), ("user", "about newer_name")]
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps({"message": {"role": r, "content": t}}) for r, t in rows))
    terms = hook.recent_terms(str(tmp_path / "t.jsonl"), "x.py")
    assert terms.index("newer_name") < terms.index("older_name")
