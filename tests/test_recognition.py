"""Recognition fixtures: words that a small dictionary accepts and rejects."""

import pytest

from glyphmill.operators.recognize import Recognizer
from glyphmill.sources.affixfiles import import_text

#: name: (affix lines, words, accepted, rejected)
CASES = {
    "lookbehind": ("SFX A N 1;SFX A 0 x (^|[^o])stem;SFX B N 1;SFX B 0 x (?<!i)[z]word;SFX C N 1;SFX C 0 x (^whole)", "6;stem/A;astem/A;ostem/A;zword/B;izword/B;whole/C", "stemx astemx zwordx wholex", "ostemx izwordx"),
    "conversions": ("ICONV 3;ICONV ab x;ICONV x y;ICONV _pre 0", "2;x;word", "ab preword", "y"),
    "full strip": ("FULLSTRIP;SFX A N 1;SFX A word s .", "1;word/A", "s", ""),
    "no full strip": ("SFX A N 1;SFX A word s .", "1;word/A", "word", "s"),
    "numeric aliases": ("FLAG num;AF 2;AF 1,2;AF 3;NEEDAFFIX 1;SFX 2 N 1;SFX 2 0 s/2 .;SFX 3 N 1;SFX 3 0 ed .", "2;root/1;plain/2", "roots plain plained", "root"),
    "chain limits": ("PFX A Y 1;PFX A 0 un/D .;PFX D Y 1;PFX D 0 re .;SFX B Y 1;SFX B 0 s/C .;SFX C Y 1;SFX C 0 x/D .;SFX D Y 1;SFX D 0 y .", "1;word/AB", "unword wordsx", "reunword wordsxy"),
    "special flags": ("CIRCUMFIX C;FORBIDDENWORD F;NEEDAFFIX N;KEEPCASE K;COMPOUNDFLAG M;COMPOUNDMIN 3;PFX A Y 1;PFX A 0 un/C .;SFX B Y 1;SFX B 0 s/C .;PFX D N 1;PFX D 0 re .", "6;word/AB;fix/DN;bad/AF;Haus/M;tür/M;OAuth/K", "word unwords refix Haustür OAuth", "unword words fix bad unbad HausHa"),
    "breaks": ("BREAK 3;BREAK --;BREAK ^';BREAK '$", "3;foo;bar;word", "foo--bar 'word word'", "foo--bar--foo"),
    "turkic": ("LANG tr_TR;KEEPCASE K", "3;i;ışık;Ankara/K", "İ IŞIK Ankara", "ANKARA"),
    "sharp s": ("CHECKSHARPS;KEEPCASE K", "2;Straße/K;Maße", "Straße STRASSE", "STRAẞE MASSE"),
    "compound rule": ("COMPOUNDMIN 1;COMPOUNDRULE 1;COMPOUNDRULE A*B", "2;a/A;b/B", "aab", "ba"),
    "positions": ("COMPOUNDBEGIN B;COMPOUNDMIDDLE M;COMPOUNDEND E;ONLYINCOMPOUND O;COMPOUNDMIN 1", "4;Bahn/B;Hof/M;Straße/E;Teil/BO", "BahnStraße BahnHofStraße TeilStraße", "Teil HofStraße BahnHof"),
    "permit": ("COMPOUNDBEGIN B;COMPOUNDEND E;COMPOUNDPERMITFLAG P;COMPOUNDMIN 1;SFX A N 1;SFX A 0 s/P .;SFX C N 1;SFX C 0 x .", "3;root/BA;plain/BC;end/E", "rootsend", "plainxend"),
    "triples": ("COMPOUNDFLAG C;COMPOUNDMIN 1;CHECKCOMPOUNDTRIPLE;SIMPLIFIEDTRIPLE", "2;Schiff/C;fahrt/C", "Schiffahrt", "Schifffahrt"),
    "pattern replacement": ("COMPOUNDFLAG C;COMPOUNDMIN 1;CHECKCOMPOUNDPATTERN 1;CHECKCOMPOUNDPATTERN ff f ff", "2;Schiff/C;fahrt/C", "Schifffahrt Schiff", "Schiffaahrt"),
    "safeguards": (
        "COMPOUNDFLAG C;COMPOUNDMIN 1;COMPOUNDFORBIDFLAG F;COMPOUNDWORDMAX 2 C;COMPOUNDSYLLABLE 1 a;CHECKCOMPOUNDDUP;CHECKCOMPOUNDCASE;CHECKCOMPOUNDTRIPLE;CHECKCOMPOUNDREP;FORCEUCASE U;CHECKCOMPOUNDPATTERN 1;CHECKCOMPOUNDPATTERN foo/A bar/B;REP 1;REP quxbar known",
        "13;foo/CA;bar/CB;Bar/CB;ox/C;bad/CF;main/C;Main/C;street/CU;a/C;b/C;c/C;known;qux/C",
        "foobad Mainstreet abc", "foobar badfoo foofoo fooox fooBar mainstreet quxbar",
    ),
    "inflected": ("SFX N Y 1;SFX N 0 n .;COMPOUNDFLAG C;COMPOUNDMIN 1", "3;House/N;Rail/C;Way/C", "House Housen RailWay HOUSE", "missing"),
}


@pytest.mark.parametrize("name", CASES)
def test_fixture(spark, name):
    aff, dic, accepted, rejected = CASES[name]
    dictionary = import_text(aff.replace(";", "\n"), dic.replace(";", "\n"))
    words = [*accepted.split(), *rejected.split()]
    found = dict(Recognizer(spark, dictionary).contains(spark.createDataFrame([(w,) for w in words], "word string")).collect())
    assert [w for w in accepted.split() if not found[w]] == []
    assert [w for w in rejected.split() if found[w]] == []


def test_candidate_limit_stops_chains_only(spark):
    """A rule that adds nothing makes every lexeme an origin: over 8,192 of them, chains do not count."""
    aff = "SFX A Y 1\nSFX A 0 0/B .\nSFX B Y 1\nSFX B 0 s .\n"
    for n, chain in ((20, True), (8193, False)):
        dictionary = import_text(aff, f"{n}\n" + "\n".join(f"word{k}/A" for k in range(n)))
        words = spark.createDataFrame([("word1",), ("word1s",)], "word string")
        found = dict(Recognizer(spark, dictionary).contains(words).collect())
        assert found == {"word1": True, "word1s": chain}


def test_explanations(spark):
    dictionary = import_text("FORBIDDENWORD F\nSFX S Y 1\nSFX S 0 s .\nCOMPOUNDFLAG C\nCOMPOUNDMIN 2", "4\ncat/SC\ndog/C\nbad/F\nbird")
    words = ["cat", "cats", "catdog", "BIRD", "cat-bird", "bad", "zzz"]
    rows = Recognizer(spark, dictionary).explain(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    told = {r["word"]: (r["accepted"], r["casing"], r["kind"], r["reason"]) for r in rows}
    assert told == {
        "cat": (True, "exact", "stem", None), "cats": (True, "exact", "affix", None), "catdog": (True, "exact", "compound", None),
        "BIRD": (True, "lower", "stem", None), "cat-bird": (True, "exact", "break", None), "bad": (False, None, None, "forbidden"), "zzz": (False, None, None, "unknown"),
    }
