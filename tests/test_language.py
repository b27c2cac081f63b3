import pytest
from sitecount.functions.language import names, parse
from sitecount.functions.template import pieces
from sitecount.plans.regions import parse_region
from sitecount.schema import CountingError, ExpressionError, RegionError, flag_mask, format_options


@pytest.mark.parametrize(
    ("source", "same"),
    [
        ("a && b || !c", "a and b or not c"),
        ("a != 1", "a ~= 1"),
        ("flags & 16 == 0", "(flags & 16) == 0"),
        ("-2 ^ 2", "-(2 ^ 2)"),
        ("2 ^ 3 ^ 2", "2 ^ (3 ^ 2)"),
        ("a .. b .. c", "a .. (b .. c)"),
        ("not a == b", "(not a) == b"),
        ("1 + 2 * 3 - 4", "(1 + (2 * 3)) - 4"),
        ("a < 1 and b > 2 or c", "((a < 1) and (b > 2)) or c"),
        ("[NS] <= 1", "tag('NS') <= 1"),
        ("exists([NS])", "exists('NS')"),
        ("flag.dup == 0", "(flag & 1024) == 0"),
        ("rname =~ 'x.*'", "re_match(rname, 'x.*')"),
        ("rname !~ 'x'", "not re_match(rname, 'x')"),
        ("return mapq", "mapq"),
        ("mapq>=20&&bq>=20", "mapq >= 20 and bq >= 20"),
        ("0x10 | 1", "16 | 1"),
    ],
)
def test_sugar_and_precedence(source, same):
    assert parse(source) == parse(same)


@pytest.mark.parametrize("bad", ["", "(", "(( not lua !!", "a +", "1 2", "flag.nosuch", "a =~ b", "'open", "3 =~ 'x'", "f(1"])
def test_syntax_errors(bad):
    with pytest.raises(ExpressionError):
        parse(bad)


def test_names_and_pieces():
    assert names(parse("a + f(b) and read.c")) == {"a", "f", "b", "read.c"}
    assert pieces("{{x\\t{a.0}}{b}") == [("text", "{x\t"), ("cell", "a0"), ("text", "}"), ("cell", "b")]
    for bad in ("{a", "{}"):
        with pytest.raises(ExpressionError):
            pieces(bad)


def test_flags_and_regions():
    assert flag_mask("dup,UNMAP,0x10,2") == 1024 | 4 | 16 | 2 and flag_mask(None) == 0
    assert format_options("reqflags=read1,exclflags=dup,reverse") == (64 | 16, 1024)
    with pytest.raises(CountingError):
        flag_mask("nosuch")
    assert parse_region("chr1:1-40") == ("chr1", 0, 40) and parse_region("a:b:5") == ("a:b", 4, 0)
    for bad in ("chr1", ":1-2", "chr1:x-y"):
        with pytest.raises(RegionError):
            parse_region(bad)
