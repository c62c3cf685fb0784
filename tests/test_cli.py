"""The command line's functions on a small corpus."""

import json

from colloquy import __main__ as cli
from colloquy.sources import readers

TOPICS = {"経済産業大臣": ("半導体の生産", "経済産業省"), "環境省局長": ("廃棄物の回収", "環境省")}


def corpus(spark, path):
    meetings = []
    for i in range(10):
        speeches = []
        for n, (title, (topic, _)) in enumerate(TOPICS.items()):
            speeches.append({"speechID": f"{i}q{n}", "speechOrder": str(2 * n + 1), "speaker": "山田", "speakerGroup": "党", "speech": f"{topic}について{i}番目の質問をいたしますが、政府としてはどのような見解をお持ちなのか伺います。", "speechURL": f"q{i}{n}"})
            speeches.append({"speechID": f"{i}a{n}", "speechOrder": str(2 * n + 2), "speaker": "鈴木", "speakerPosition": title, "speech": f"{topic}を進めてまいります。", "speechURL": f"a{i}{n}"})
        meetings.append({"issueID": f"m{i}", "date": f"2024-01-{i + 1:02}", "nameOfMeeting": "委員会", "speechRecord": speeches})
    path.write_text("\n".join(json.dumps(m, ensure_ascii=False) for m in meetings))
    return readers.read_meetings(spark, str(path))


def test_cli(spark, tmp_path):
    turns = corpus(spark, tmp_path / "m.json")
    pairs = cli.collect(turns, ["半導体", "廃棄物"], None, None, 10).cache()
    assert pairs.columns == cli.COLUMNS and pairs.count() == 20
    got = cli.predict(pairs, "半導体の生産はどうなりますか")
    assert got["predictions"][0]["ministry"] == "経済産業省" and sum(p["percent"] for p in got["predictions"]) == 100 and len(got["evidence"]) == 8
    own = cli.evaluate(pairs)
    assert own["total"] == 4 and own["accuracy"] == 1.0 and own["confusion"] == []
    found = cli.search(turns, "半導体の生産について教えてください", (), "", 2024, False)
    assert found["candidates"] and {r["ministry"] for r in found["candidates"]} == {"経済産業省"} and found["scans"] <= 3
    yearly = cli.search(turns, "半導体の生産について教えてください", (), "2023-01-01", 2024, True)
    assert [(s["ministry"], s["percent"]) for s in yearly["shares"]] == [("経済産業省", 100)]
