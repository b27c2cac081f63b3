import pytest
from sitecount.cli import main
from sitecount.functions.compiler import Compiler, text_of
from sitecount.functions.language import parse
from sitecount.functions.strings import pattern_of
from sitecount.functions.values import opened
from sitecount.schema import ExpressionError, UnsupportedExpression

VALUES = {
    "string.find('abca', 'a', 2, true)": "4",
    "string.find('abca', 'a', -1)": "4",
    "string.find('a.c', '.', 2, true)": "2",
    "string.find('abc', '.c')": "2",
    "string.find('abc', '^b')": "nil",
    "string.find('abc', '^b', 2)": "2",
    "string.find('abc', 'c$')": "3",
    "string.find('abc', '')": "1",
    "string.find('abc', '', 5)": "nil",
    "string.find('a+b', '%+')": "2",
    "string.find('chr12', '[0-9]')": "4",
    "string.find('chr12', '[^a-z]', 5)": "5",
    "string.find('x]y', '[]]')": "2",
    "string.match('key = value', '^(%w+)%s*=%s*(%w+)$')": "key",
    "string.match('a1b22', '%d+', 3)": "22",
    "string.match('<<a>>', '<(.-)>')": "<a",
    "string.match('abc', '%d')": "nil",
    "string.gsub('hello world', 'o', '0')": "hell0 w0rld",
    "string.gsub('abc', '%w', '%0%0')": "aabbcc",
    "string.gsub('abc', '(a)(b)', '%2%1')": "bac",
    "string.gsub('cost', 'c', '$1\\\\')": "$1\\ost",
    "string.gsub('100', '0', '%%')": "1%%",
    "string.format('%5.1f|%-4s|%04d|%x|%%', 3.14159, 'ab', 7, 255)": "  3.1|ab  |0007|ff|%",
    "string.format('%s %s', nil, 2.0)": "nil 2.0",
    "string.format('%d', 3.0)": "3",
    "string.char(72, 105)": "Hi",
    "string.match('to: a.b-c@d.e f', '[%w._-]+@%S+')": "a.b-c@d.e",
    "string.match('x#y', '[^%w]')": "#",
    "math.ult(1, -1)": "true",
    "math.ult(-1, 1)": "false",
    "math.modf(-3.7)": "-3.0",
    "math.modf(5)": "5",
}


def test_values(spark):
    cells = []
    for source in VALUES:
        value = opened(Compiler({}).compile(parse(source)))
        cells.append(value.pick(lambda k, c: text_of(k, c)))
    got = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cells)]).collect()[0]
    assert dict(zip(VALUES, got, strict=True)) == VALUES


def test_failures(spark):
    for source in ("string.format('%d', 3.5)", "string.char(200)", "string.find(nil, 'x')"):
        value = opened(Compiler({}).compile(parse(source)))
        assert spark.range(1).select(value.fails()).collect()[0][0] is True, source


@pytest.mark.parametrize("source", ["string.find('a', 'b' .. '.')", "string.match('a', '%b()')", "string.match('a', '()')", "string.gmatch('a', 'a')", "string.gsub('a', 'a', 'b', 1)", "string.format('%q', 'x')", "string.match('a', '%f[a]')"])
def test_what_is_not_offered_is_refused(source):
    with pytest.raises(UnsupportedExpression):
        Compiler({}).compile(parse(source))


@pytest.mark.parametrize("source", ["string.match('a', '(a')", "string.match('a', '[a')", "string.format('%d')", "string.format('%')", "string.gsub('a', 'a', '%2')"])
def test_broken_patterns_and_formats(source):
    with pytest.raises(ExpressionError):
        Compiler({}).compile(parse(source))


def test_patterns():
    assert pattern_of("^a.%.b-$") == (r"(?s)^a.\.b*?\z", 0) and pattern_of("(%a)([%d_])")[1] == 2


def test_usage_errors_exit_with_1(capsys):
    for args in ([], ["-i", "x"], ["-i", "x", "-r", "y", "--strand", "sideways"]):
        with pytest.raises(SystemExit) as e:
            main(args)
        assert e.value.code == 1
