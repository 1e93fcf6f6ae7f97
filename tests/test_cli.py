import json

from trawl.__main__ import build_parser, main
from trawl.sources.collection import Collection


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_commands_from_chunks_to_keys(spark, tmp_path, capsys):
    words = ["supply chain", "gaming revenue", "tax risk", "climate", "employees fddei"]
    for ticker in ("NVDA", "TSLA"):
        lines = [
            {"chunk_id": f"{ticker}-2026-01-01-{i:04d}", "text": f"{ticker} {w}. " * 3, "metadata": {"ticker": ticker, "section": "s"}}
            for i, w in enumerate(words)
        ]
        write(tmp_path / "chunks" / f"ticker={ticker}" / "c.json", "\n".join(map(json.dumps, lines)))
    golden = [
        {"id": 1, "question": "nvda gaming revenue", "company": "NVDA", "category": "semantic", "relevant_ids": ["NVDA-2026-01-01-0001"], "recall_reliable": True},
        {"id": 2, "question": "fddei", "company": None, "category": "lexical", "relevant_ids": ["TSLA-2026-01-01-0004"], "recall_reliable": False},
        {"id": 3, "question": "home address", "company": None, "category": "control", "relevant_ids": []},
    ]
    write(tmp_path / "golden.jsonl", "\n".join(map(json.dumps, golden)))
    verdicts = {"claude-haiku-4-5#v2": {"nvda gaming revenue": {"NVDA-2026-01-01-0001": True}, "fddei": {"NVDA-2026-01-01-0004": True}}}
    write(tmp_path / "judge_cache.json", json.dumps(verdicts))

    def run(*argv):
        main(["--data", str(tmp_path), "--embedder", "hashed", *argv])
        return capsys.readouterr().out

    assert "upserted 10 chunks" in run("build")
    assert "holds 10" in run("store", "--ticker", "tsla")
    assert "NVDA" in run("inspect")
    assert "similarity" in run("embed", "--text", "tax", "--text", "tax risk", "--text", "cars")
    assert "norm" in run("embed", "--text", "tax")
    out = run("retrieve", "--question", "tesla tax risk", "--company", "nvda", "--k", "2")
    assert "WARNING" in out and "NVDA-2026-01-01-0002" in out
    assert "open_rank" in run("retrieve", "--question", "tax", "--company", "tsla", "--compare")
    assert "Question: nvda" in run("ask", "--question", "nvda tsla gaming revenue", "--k", "4")
    out = run("eval", "--hybrid", "--fusion", "interleave", "--hybrid-gate", "--decompose", "--expand", "--llm-decompose")
    assert "recall of 5 1.00" in out and "best match" in out
    assert "MRR" in run("eval", "--mmr", "--rerank", "--reranker", "overlap", "--depth", "5")
    out = run("judge", "--build-key")
    assert '"passed": true' in out and "0004" in out
    assert "2 whole keys" in run("eval", "--judge-key")


def test_chunk_command(spark, tmp_path, capsys):
    filing = {"ticker": "T", "filing_date": "2026-01-01", "sections": [{"section": "s", "text": "Some words. " * 200}]}
    write(tmp_path / "clean" / "T" / "f.json", json.dumps(filing))
    main(["--data", str(tmp_path), "--embedder", "hashed", "chunk", "--ticker", "t"])
    assert "T-2026-01-01-0001" in capsys.readouterr().out
    main(["--data", str(tmp_path), "--embedder", "hashed", "build"])
    assert Collection(spark, f"{tmp_path}/collection").count("T") > 1


def test_every_option_of_eval_and_judge_parses():
    args = build_parser().parse_args(
        "eval --depth 20 --rerank --candidates 30 --reranker bge --mmr --mmr-lambda 0 --hybrid --fusion rrf --rrf-k 10 "
        "--hybrid-gate --decompose --llm-decompose --decomposer opus --sub-filter --expand --expander sonnet --judge-key".split()
    )
    assert args.mmr_lambda == 0.0 and args.rrf_k == 10
    assert build_parser().parse_args("judge --judge-model opus --pool 5 --neg-sample 3 --build-key --force".split()).force
