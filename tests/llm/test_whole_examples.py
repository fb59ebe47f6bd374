from gradeloom.llm import chat


def test_registered_path_reads_whole_examples(spark, monkeypatch):
    rows = [(1, k, ["user", "assistant"][k % 2], f"t{k} # <") for k in range(7)] + [(2, 0, "user", "no reply")]
    seen = []
    plain = chat.read_back
    monkeypatch.setattr(chat, "read_back", lambda whole: seen.append(whole) or plain(whole))
    out = {r.conv_id: r for r in chat.op9(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    made = sorted((r for r in seen[0].collect() if r.conv_id == 1), key=lambda r: r.example)
    said = ["### {}: {}</turn>\n".format(r, x.replace("#", "\\h").replace("<", "\\l")) for c, _, r, x in rows if c == 1]
    assert [r.text for r in made] == ["".join(said[:n]) for n in (2, 4, 6, 7)]
    assert [r.text[r.loss_start:r.loss_end] for r in made[:3]] == [f"t{k} \\h \\l" for k in (1, 3, 5)]
    assert out[1].n_turns == 7 and out[1].formatted_chars == len("".join(said)) and out[2].loss_chars == 0
