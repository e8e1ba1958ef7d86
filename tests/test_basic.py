"""Token lines of programs against known bytes, and back."""

import pytest

from fluxmere.functions import basic

#: Fixed: programs, the bytes that the machine's own interpreter makes of them, and its listings.
KNOWN = [
    ('10 PRINT CHR$(4);"PREFIX": INPUT PR$\n', "19080A00BAE72834293B22505245464958223A84505224000000", '10  PRINT  CHR$ (4);"PREFIX": INPUT PR$\n'),
    ('10 input ""; a$\n', "0C080A008422223B4124000000", '10  INPUT "";A$\n'),
    ('10 HOME\n20 PRI NT "HELLO"  ', "07080A00970014081400BA2248454C4C4F22000000", '10  HOME \n20  PRINT "HELLO"\n'),
    ("10 print a,b, ,c;d$;;;e$", "15080A00BA412C422C2C433B44243B3B3B4524000000", "10  PRINT A,B,,C;D$;;;E$\n"),
    ('10 DATA aliteral, "a string", 1  : PRINT A$\n', "25080A008320616C69746572616C2C20226120737472696E67222C203120203ABA4124000000", '10  DATA  aliteral, "a string", 1  : PRINT A$\n'),
    ("10 x = 1e6*(fn cub(x0) + (atn(x1) + cos(x2))*5)\n", "26080A0058D0314536CA28C243554228583029C828E128583129C8DE2858322929CA3529000000", "10 X = 1E6 * ( FN CUB(X0) + ( ATN (X1) +  COS (X2)) * 5)\n"),
    ('10 if x then a$ = a$ + "hello\n', "15080A00AD58C44124D04124C82268656C6C6F000000", None),
    ("10 hgr: hcolor=2\n20 x=5:y=5\n30 plot x,y\r\n40 hplot to x+5,y+5", "0A080A00913A9232001608140058D0353A59D035001F081E008D582C59002D08280093C158C8352C59C835000000", None),
    ("10 for i = 1 to last: print i: next i", "15080A008149D031C14C4153543ABA493A8249000000", None),
    ('10 print "\\x0d1\\x0d2\\x0a\\x0a"', "0F080A00BA220D310D320A0A22000000", '10  PRINT "\\x0d1\\x0d2\\x0a\\x0a"\n'),
    ('10 data ":",\\x5Cxff : rem \\\\\\\\', "18080A008320223A222C5C786666203AB2205C5C5C5C000000", '10  DATA  ":",\\x5cxff : REM  \\\\\\\\\n'),
    ("10 rem \\x0a\\x0aAAA\\x0a\\x0a", "0F080A00B2200A0A4141410A0A000000", "10  REM  \\x0a\\x0aAAA\\x0a\\x0a\n"),
    ("10 xdraw 1 at 5,y(3)", "0F080A009531C5352C59283329000000", None),
]


@pytest.mark.parametrize("program, tokens, listing", KNOWN)
def test_known(program, tokens, listing):
    assert basic.tokenize(program).hex().upper() == tokens
    assert listing is None or basic.detokenize(bytes.fromhex(tokens)) == listing


def test_there_and_back():
    """But for remarks and data, whose listing has a blank more."""
    for program, tokens, _ in KNOWN:
        if "B2" in tokens or "83" in tokens[8:12]:
            continue
        again = basic.tokenize(basic.detokenize(bytes.fromhex(tokens)))
        assert again.hex().upper() == tokens, program


def test_table_and_limits():
    assert len(basic.TOKENS) == 107 and basic.TOKENS[0x3A] == "PRINT"
    assert basic.tokenize("") == basic.tokenize("\n \n") == b"\0\0" and basic.detokenize(b"") == basic.detokenize(b"\0\0") == ""
    for bad in ("PRINT", "64000 END"):
        with pytest.raises(ValueError, match="number"):
            basic.tokenize(bad)
    with pytest.raises(ValueError, match="long"):
        basic.detokenize(basic.tokenize("10 REM" + "x" * 300))


def test_columns(spark):
    rows = spark.createDataFrame([(1, "10 HOME"), (2, None), (3, "no number"), (4, "")], "id long, program string")
    got = rows.select("id", basic.tokens(rows.program).alias("t")).select("id", "t", basic.listing("t").alias("l")).collect()
    assert {r.id: (r.t and bytes(r.t).hex(), r.l) for r in got} == {1: ("07080a0097000000", "10  HOME \n"), 2: (None, None), 3: (None, None), 4: ("0000", "")}


def test_pieces_are_worked_out_once():
    basic._code.cache_clear(), basic._shown.cache_clear()
    for k in range(50):
        program = f'10 print "ITEM {k}": goto 10\n20 rem "a" : print\n30 data "x:y": at n "\\x41"'
        assert basic.detokenize(basic.tokenize(program)) == f'10  PRINT "ITEM {k}": GOTO 10\n20  REM  "a" : print\n30  DATA  "x:y": ATN "A"\n'
    assert basic._code.cache_info().misses <= 8 and basic._shown.cache_info().misses <= 8
