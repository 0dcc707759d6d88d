"""Every operator on a table whose other columns are named like its outputs and like names that operators use inside."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sediment.llm import byte_cnn, fingerprint, html_text, minhash, mixing, packing, pii, quality_rules, secret_scan

NAMES = """__text __words __lines __hash __sorted __at __html __spans __row __doc __range __first __before __bucket __source __digest __key __id __gone __part __copy
    a b i j k x key kind node items order found gap start end e at side size tie bucket target copies source_size spans score value c0 c1 c2 r v guest rep band bands component
    component_id set_id n_shingles kept fingerprint tree n_words word_chars base_failed symbol_ratio ids offset sequence_id html span.s""".split()
TEXT = "the river of the night and the stone of the house and the paper in the window of the green hill under the seven trees call me on a@b.cd token = abcdefgh1"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{TEXT} number{i} " + " ".join(f"w{i}x{j}" for j in range(30)), "en", "a", 7, *range(len(NAMES))) for i in range(4)]
    rows += [(4, None, None, None, None, *range(len(NAMES))), (None, "", "en", "b", 0, *range(len(NAMES)))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in NAMES))


def carried(d, out, replaced):
    """The columns of ``d`` that an operator carries hold what they held."""
    same = [c for c in d.columns if c not in replaced and c != "text"]
    assert [c for c in out.columns if c in same] == same
    rows = lambda x: sorted(map(str, x.select(*[F.col(f"`{c}`") for c in same]).collect()))
    assert rows(out) == rows(d)


@pytest.mark.parametrize(
    "operator,replaced",
    [
        (fingerprint.fingerprinted, ["fingerprint", "tree"]),
        (lambda d: byte_cnn.scored(d, byte_cnn.Network(share=0.5)), ["score"]),
        (pii.found, ["spans"]),
        (pii.redacted, ["n_chars"]),
        (secret_scan.found, ["spans"]),
        (quality_rules.judged, [*quality_rules.MEASURES, "base_failed", "kept", *[r.name for r in quality_rules.RULES]]),
        (lambda d: html_text.extracted(d, "text", "html"), ["html"]),
        (minhash.deduplicated, []),
    ],
)
def test_other_columns_are_carried(docs, operator, replaced):
    carried(docs, operator(docs), replaced)


def test_operators_that_select_or_repeat_rows(spark, docs):
    assert quality_rules.filtered(docs).columns == docs.columns and quality_rules.filtered(docs).count() == 4
    out = mixing.repeated(docs)
    assert out.columns == docs.columns and out.select("doc_id").distinct().count() >= 1
    assert packing.packed(docs).select("doc_id").distinct().count() == 6
    assert {r.kind for r in secret_scan.spans(docs).collect()} == {"assign"}
    for f in (quality_rules.op6_quality_rules, pii.op4_pii, secret_scan.op5_secret_scan, minhash.op2_near_dedup, mixing.op9_mixing, fingerprint.op1_fingerprint):
        assert f(docs).count() == 6


def test_pipeline_stages(spark, docs):
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, "")
        assert out.columns == d.columns, name
        assert out.count() <= 3 * d.count()
    assert corpus_pipeline.STAGES[-1][1](spark, d, "").select("doc_id").distinct().count() == 6
