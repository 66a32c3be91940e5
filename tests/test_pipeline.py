import json

from mnesis import agent, cli
from mnesis.operators.segment import SegmentConfig
from mnesis.pipeline import build, evaluate, grid_search


def test_build_recall_and_summary(spark, tmp_path):
    chat = tmp_path / "chat.txt"
    lines = [f"2026-02-0{d}, 08 h {m:02d} - Alice: budget meeting about the grant {m}" for d in (1, 4) for m in range(5)] + [f"2026-02-03, 20 h {m:02d} - Bob: school trip with the children {m}" for m in range(4)]
    chat.write_text("\n".join(lines) + "\n")
    tables = build(spark, [str(chat)])
    assert tables["episodes"].count() == 3 and tables["membership"].count() == 14
    assert evaluate(tables).collect()[0].n in (0, None)
    out = cli.main(["build", str(chat), "--store", str(tmp_path / "s")], spark)
    assert out.startswith("3 episodes")
    assert "raw: 3" in cli.main(["summary", str(tmp_path / "s")], spark)
    assert "school" in cli.main(["recall", str(tmp_path / "s"), "school trip children", "--top-k", "1"], spark)
    g = grid_search(tables["artifacts"].limit(14), (0.3,), (120.0,)).collect()
    assert len(g) == 1


def test_build_consolidates_and_splits(spark, tmp_path):
    csv = tmp_path / "d.csv"
    row = lambda i, t, c, e: f'A{i},{t},"{c}","{e}",'
    rows = [row(i, f"2026-02-01 08:{i:02d}", "budget meeting grant", "grant, office") for i in range(4)] + [row(10 + i, f"2026-02-03 08:{i:02d}", "budget meeting grant", "grant, office") for i in range(3)]
    rows += [row(20 + i, f"2026-02-20 08:{i:02d}", ("budget meeting grant", "school trip children", "clinic doctor nurse", "garden flowers rain")[i % 4], "house, street") for i in range(12)]
    csv.write_text("artifact_id,timestamp,content,entities,true_episode_id\n" + "\n".join(rows) + "\n")
    tables = build(spark, [str(csv)], config=SegmentConfig(threshold=0.0, hard_break_minutes=720))
    eps = {r.episode_id: r for r in tables["episodes"].collect()}
    of = {r.id: r.episode_id for r in tables["membership"].collect()}
    assert len(of) == 19 and len({of[f"A{i}"] for i in (0, 1, 2, 3, 10, 11, 12)}) == 1
    joined = eps[of["A0"]]
    assert (joined.status, joined.message_count, round(joined.memory, 6)) == ("consolidated", 7, 2.25)
    topics = [{of[f"A{20 + i}"] for i in range(t, 12, 4)} for t in range(4)]
    assert all(len(t) == 1 for t in topics) and {max(t)[-4:] for t in topics} == {"_S01", "_S02", "_S03", "_S04"}
    assert len(eps) == 5 and round(eps[of["A20"]].memory, 6) == 0.3875 and eps[of["A20"]].status == "raw"


def test_context_fits_its_budget():
    eps = [{"episode_id": f"E{i}", "label": "l", "relevance": 0.5, "summary": "s" * 3000, "quotes": ["q"]} for i in range(12)]
    text = agent.build_context(eps)
    assert len(text) <= 8000 and text.count("s" * 3000) == 2 and text.endswith("(+ 5 more)")
    a = agent.MemoryAgent(lambda q, k: eps[:k], lambda s, u: u.upper())
    assert a.respond("hi") == "HI" and a.explain_last().startswith("E0, E1")


def test_reply_parsers():
    assert agent.parse_entities('```json\n{"entities": [{"text": "Ana", "type": "per", "confidence": 3}, {"text": " "}, 5,]}\n```') == [{"text": "Ana", "type": "PERSON", "confidence": 1.0}]
    assert agent.parse_entities("nothing") == [] and agent.parse_entities(None) == []
    assert agent.parse_entities_of_many(json.dumps({"MSG1": {"entities": [{"text": "X"}]}}))["MSG1"][0]["type"] == "UNKNOWN"
    assert agent.parse_summary('{"label": "a", "summary": "b"}')["mood"] == "neutral"
    assert agent.parse_boundary('{"boundary": false, "confidence": 0.9}') == 1 - 0.9 and agent.parse_boundary("oui") == 0.6 and agent.parse_boundary("?") == 0.7 and agent.parse_boundary("un nouveau sujet") == 0.6
