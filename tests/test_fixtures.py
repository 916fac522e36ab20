"""Rows of expected verdicts: own ones, and all files of the folders that the environment names.

GLYPHLOOM_FIXTURES holds ``<Family>Test.txt`` files, GLYPHLOOM_WORDLISTS one word list a language.
"""

import os

import pytest

from glyphloom.operators import fixtures
from glyphloom.sources import delimited


#: Own rows of each family: input, tag, positions and claims about its figures.
OWN = {
    "TagBlockPayload": "0061 E0041 E0042; Hazard:MixedBlock; 1, 2; tag_count=2; total_cps=3;",
    "VariationSelectorPayload": "0061 E0101; Hazard:IllegalTarget; 1; registered_vs=0; suspicious_vs=1;",
    "ZeroWidthPayload": "200B 200B 0061; Hazard:BinaryPayload; 0, 1; zwsp_count=2; zwj_count=0; wj_count=0; nnbsp_count=0;",
    "BidiControlBalance": "0061 202E 2066; Hazard:UnbalancedEmbedding; 1, 2; emb_open=1; emb_pop=0; iso_open=1; iso_pop=0; max_depth=2;",
    "HomoglyphConfusable": "FF21; Hazard:WidthClass; 0;",
    "MixedScriptAdmissibility": "0061 0430; Hazard:LatinCyrillic; 1;",
    "EmojiZwjIntegrity": "1F468 200D 1F469 200D 1F467; Clear; ; chain_len=5; zwj_count=2; skin_tone_count=0; is_rgi=true;",
    "SkinToneVariationForgery": "0061 1F3FB FE0F; Hazard:InvalidSkinToneTarget; 1; skin_tone_count=1; vs15_count=0; vs16_count=1;",
    "SourceDisplayDivergence": "0061 200B; Hazard:ZeroWidth; ;",
    "FilenameDisguise": "0061 002E 0062 002E 0063 002E 0064; Hazard:MultipleExtensions; 1, 3, 5; dot_count=3; bidi_count=0; fw_in_ext=0; comb_in_ext=0;",
    "RtlInjection": "05D0 05D1 0061; Hazard:FieldTakeover; 0; strong_rtl=2; strong_ltr=1; bidi_count=0; longest_run=2;",
    "RendererDivergence": "FF21 0061; Hazard:FullwidthVariance; 0; vs_count=0; comb_count=0; fw_count=1; has_zwj=false; ltr_count=2; rtl_count=0;",
    "NormalizationBomb": "FDFA; Hazard:SingleCpBlowup; 0; nfd_len=1; nfkd_len=18; input_len=1; max_per_cp=18;",
    "StreamSafeViolation": "0061 0301 0327 0062 0301; Clear; ; max_run=2; overruns=0; total_ns=3;",
    "LocaleCaseInversion": "0061 0049; Hazard:TurkishCaseDivergence; 1;",
    "CaseExpansionMismatch": "0061 00DF 0390; Hazard:UpperExpansion; 1; upper_exp=2; lower_exp=0; max_exp=3;",
    "WidthClassConfusion": "FF71 0061; Hazard:HalfwidthFold; 0; fw_fold=0; hw_fold=1;",
    "NfcIdempotenceWitness": "0065 0301 FF21; Hazard:NonNfcForm; 0; nfc_len=2; nfkc_len=2;",
    "IdentifierFormDrift": "0061 FF21; Hazard:IdentifierStatusShift; 1; shift_count=1;",
    "CovertDisplayCompound": "202E E0041; Hazard:BidiPlusTagBlock; 0, 1;",
    "ConfusableBidiCompound": "202E 006D; Hazard:ConfusableInOverride; 1, 0; conf_count=1;",
    "AdmissibilityFormDrift": "FF21 0062; Hazard:AdmissibilityFormDrift; ; input_adm=false; nfkc_adm=true;",
    "AiWatermarkDetectability": "0061 202F 0062; Hazard:NnbspBoundary; 1; markerCount=1;",
}


#: Families whose rows have a context, word lists or bytes.
MORE = {
    "Bip39Canonical": "0061 0020 0062; Clear; ; wordCount=2; language=x; # both of one list\n0061 0020 007A; Hazard:WordlistMismatch; 1; language=x; # second of none, no language then\n"
    "0061 0020 0063; Hazard:LanguageAmbiguous; ; # no list has both\n0061 0020; Hazard:TrailingWhitespace; 1; wordCount=1; # end\n",
    "HashInputStability": "0061; Hazard:EncodingMismatch; 0; declaredEnc=latin1; # encoding\n0061; Hazard:WebhookSignatureDrift; 0; serverBytes=0062; # other bytes\n0061; Clear; ; # none\n"
    "0061 0020; Hazard:TrailingWhitespace; 1; stableSize=1; # right\n0061; Clear; ; stableSize=2; # wrong claim\n0061; Clear; ; stableSize=x; # no number\n",
    "SurrogateReassembly": "0061 00C3; Hazard:Truncated; 2; # cut\n00E9; Hazard:Truncated; 1; # lone\n00ED 00A0 0080; Hazard:Cesu8; 2; # surrogate\n",
}


def test_own_rows(spark, tmp_path):
    for family, row in OWN.items():
        (tmp_path / f"{family}Test.txt").write_text(row + " # own\n")
    for family, rows in MORE.items():
        (tmp_path / f"{family}Test.txt").write_text(rows)
    lists = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c")], "lang string, word string")
    found = fixtures.verdicts(delimited.read_fixtures(spark, str(tmp_path)), lists).collect()
    assert len(found) == len(OWN) + 13 and {r["family"] for r in found} == {*OWN, *MORE} and len({*OWN, *MORE}) == 26
    assert [(r["family"], r["line"], r["found"]) for r in found if not (r["same_tag"] and r["same_positions"])] == []
    assert sorted((r["family"], r["line"]) for r in found if not r["same_figures"]) == [("Bip39Canonical", 2), ("HashInputStability", 5), ("HashInputStability", 6)]


@pytest.mark.skipif("GLYPHLOOM_FIXTURES" not in os.environ, reason="no folder of fixture files is named")
def test_named_files(spark):
    lists = delimited.read_word_lists(spark, os.environ["GLYPHLOOM_WORDLISTS"])
    found = fixtures.verdicts(delimited.read_fixtures(spark, os.environ["GLYPHLOOM_FIXTURES"]), lists).select("family", "line", "tag", "found", "same_tag", "same_positions", "same_figures", "attribution").collect()
    wrong = [(r["family"], r["line"], r["tag"], r["found"]["tag"]) for r in found if not (r["same_tag"] and r["same_positions"])]
    claims = [(r["family"], r["line"], r["attribution"]) for r in found if not r["same_figures"]]
    print(len(found), "rows of", len({r["family"] for r in found}), "families;", len(wrong), "differ:", wrong)
    assert not wrong
    assert not claims
