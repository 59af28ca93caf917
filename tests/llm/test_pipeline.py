import corpus_pipeline as P

from demandlake.llm import decontaminate, language_id, secret_scan, simhash

from . import util
from .test_decontaminate import ITEM
from .test_tokens import check_packing, whole


def test_stages_equal_brute_force(spark, tmp_path):
    from .test_simhash import brute_components, brute_fp

    data = util.rows() + [(900, util.rows()[3][1] + " " + ITEM, "en", "src0", 1), (901, util.rows()[4][1] + " token = \"" + "0123456789abcdef" * 2 + "\"", "en", "src0", 1)]
    path = util.write_tables(spark, tmp_path, data, benchmark=[(1, ITEM)])
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "best_fit_packing"]
    got = P.run(spark, path).collect()

    model = language_id.fit(util.docs(spark, data))
    lang, _ = language_id.score_texts([r[1] for r in data], model)
    kept = [r for r, x, likely in zip(data, lang, language_id.above_floor([r[1] for r in data], model)) if x != "und" and likely]
    label = brute_components([(r[0], brute_fp(r[1])) for r in kept])
    seen, unique = set(), []
    for r, c in zip(kept, label):
        if (r[0] == c or c is None) and (c, r[0] is None and r[1]) not in seen:
            seen.add((c, r[0] is None and r[1]))
            unique.append(r)
    block = decontaminate.build([(1, ITEM)])
    clean = [r for r in unique if not list(decontaminate.matches(block, [r[1]]))]
    assert 900 in {r[0] for r in unique} and 900 not in {r[0] for r in clean}
    secrets = secret_scan.fit(util.docs(spark, clean))
    final = [(r[0], secret_scan.redact_text(r[1], secret_scan.find(r[1], secrets)), *r[2:]) for r in clean]
    assert any("[SECRET]" in r[1] for r in final)
    check_packing(got, final, whole("byte_bpe_50k.json"), 1024)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    path = util.write_tables(spark, tmp_path, [])
    docs = util.empty(spark)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == util.empty(spark).columns and docs.count() == 0
    assert P.STAGES[-1][1](spark, docs, path).count() == 0
    assert simhash.MAX_BITS == 2


def test_dedup_stage_does_not_broadcast_replicas(spark, monkeypatch):
    seen, found = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: seen.append(edges) or found(edges))
    assert P.simhash_near_dedup(spark, util.docs(spark, util.rows()[:10]), "").count() == 10
    assert "Broadcast" not in seen[0]._jdf.queryExecution().executedPlan().toString()
