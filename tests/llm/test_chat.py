import hashlib
import json

from pitwright.llm import chat, queries


def test_query_reads_back_what_went_in(spark, sample):
    rows = [(r.conv_id, r.turn, r.role, r.text or "") for r in spark.read.parquet(f"{sample}/conversations.parquet").collect()]
    planted = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", planted), (-7, 1, "assistant", planted)]
    want = {}
    for c in {r[0] for r in rows}:
        turns = [(r[2], r[3]) for r in sorted(r for r in rows if r[0] == c)]
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    got = {r.conv_id: r for r in queries.op3_chat_format(spark, sample).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want
    assert all(r.formatted_chars > r.loss_chars for r in got.values())


def test_layouts_are_recognised_by_their_paths(spark, tmp_path):
    records = [
        {"id": 1, "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "layout": "x"},
        {"id": 2, "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": "s"},
        {"id": 3, "instruction": "do", "input": "this", "output": "done"},
        {"id": 4, "instruction": "do", "output": "done"},
        {"id": 5, "prompt": "p", "response": "r", "system": "s"},
        {"id": 6, "question": "q", "answer": "a", "context": "c"},
        {"id": 7, "unknown": "u"},
        {"id": 8, "messages": [{"role": None, "content": None}, {"role": "assistant", "content": "<turn>\\</turn>\n"}]},
        {"id": 9, "prompt": "p", "messages": [{"role": "user", "content": "a"}]},
        {"id": 10, "instruction": "do", "output": None},
        {"id": 11, "messages": [{"role": "user", "content": None}, {"role": "assistant", "content": None}]},
        {"id": 12, "messages": []},
        {"id": 13, "prompt": "p", "completion": "c", "instruction": "i"},
        {"id": 14, "__turns": 5, "__choice": 6, "question": "q"},
    ]
    path = tmp_path / "records.json"
    path.write_text("\n".join(map(json.dumps, records)))
    out = chat.format_turns(chat.canonical(spark.read.json(str(path))))
    out = out.withColumn("back", chat.parse(out["formatted"])).withColumn("loss", chat.loss_text(out["formatted"], out["loss_spans"]))
    got = {r.id: r for r in out.collect()}
    turns = {i: [tuple(t) for t in r.turns_out] if r.turns_out is not None else None for i, r in got.items()}
    assert turns[1] == [("user", "a"), ("assistant", "b")]
    assert turns[2] == [("system", "s"), ("user", "a"), ("assistant", "b")]
    assert turns[3] == [("user", "do\n\nthis"), ("assistant", "done")]
    assert turns[4] == [("user", "do"), ("assistant", "done")]
    assert turns[5] == [("system", "s"), ("user", "p"), ("assistant", "r")]
    assert turns[6] == [("user", "c\n\nq"), ("assistant", "a")]
    assert turns[7] is None and got[7].formatted is None
    assert turns[8] == [("", ""), ("assistant", "<turn>\\</turn>\n")]
    assert turns[9] == [("user", "a")] and got[9].mapping == "messages"
    assert turns[10] == [("user", "do"), ("assistant", "")]
    assert turns[11] == [("user", ""), ("assistant", "")]
    assert turns[12] == [] and got[12].formatted == ""
    assert turns[13] == [("user", "p"), ("assistant", "c")]
    assert turns[14] == [("user", "q"), ("assistant", "")] and (got[14]["__turns"], got[14]["__choice"]) == (5, 6)
    assert tuple(chat.unknown(out).first()) == (14, 1)
    assert {got[i].mapping for i in (3, 4)} == {"instruction"} and got[3].layout != got[4].layout
    for i, r in got.items():
        if i != 7:
            assert [tuple(t) for t in r.back] == turns[i]
            assert r.loss == "".join(t for role, t in turns[i] if role == "assistant")
            for s in r.loss_spans:
                assert r.formatted[s.start : s.start + s.length].encode() == r.formatted.encode()[s.byte_start : s.byte_start + s.byte_length]


def test_parts_of_messages(spark, tmp_path):
    path = tmp_path / "parts.json"
    path.write_text(json.dumps({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "text": None}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": None}]}))
    [row] = chat.format_turns(chat.canonical(spark.read.json(str(path)))).collect()
    assert [tuple(t) for t in row.turns_out] == [("user", "ab"), ("assistant", "")] and row.mapping == "message_parts"
    none = chat.format_turns(chat.canonical(spark.createDataFrame([(1,)], "x int"))).first()
    assert none.turns_out is None and none.formatted is None


def test_odd_rows(spark):
    nasty = ["", "\\", "<", "<turn", "</turn>", "<turn|>", "\\<\\/turn>", "é🎉<\\turn", "a\n</turn>\n<turn>", "x" * 50_000]
    rows = [(1, i, "assistant" if i % 2 else "<turn|>", t) for i, t in enumerate(nasty)] + [(1, 0, "<turn|>", "")] + [(2, None, None, None), (None, 1, "user", "a"), (None, None, "user", "b")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_turns(chat.canonical(chat.gather(table)))
    out = out.withColumn("back", chat.parse(out["formatted"])).withColumn("loss", chat.loss_text(out["formatted"], out["loss_spans"]))
    got = {r.conv_id: r for r in out.collect()}
    assert [t.text for t in got[1].back] == ["", *nasty]
    assert got[1].loss == "".join(nasty[1::2])
    assert [tuple(t) for t in got[2].back] == [("", "")]
    assert [t.text for t in got[None].back] == ["b", "a"]
    assert chat.gather(table.limit(0)).count() == 0
