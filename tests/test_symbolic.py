"""Pairs of answers that say the same, and that don't."""

import pytest

from corpusloom.functions.symbolic import symbolic_equal

EQUAL = [(r"\frac{1}{2}","0.5"),
    (r"\frac12",".5"),
    (r"x^2-1","(x-1)(x+1)"),
    (r"\boxed{3}","3"),
    (r"\sqrt{8}",r"2\sqrt{2}"),
    (r"\sqrt{6}",r"\sqrt2\sqrt3"),
    (r"\frac{\pi}{4}",r"\pi/4"),
    ("50%","0.5"),
    ("1,000","1000"),
    ("x=5","5"),
    ("(1,2)",r"\left(1, \frac{4}{2}\right)"),
    (r"\{1,2\}",r"\{2,1\}"),
    ("1, 2","2,1"),
    (r"x = \pm 2","-2, 2"),
    (r"2\cdot 3^2","18"),
    ("-2^2","-4"),
    ("2^{-1}","1/2"),
    (r"\sin^2 x+\cos^2 x","1"),
    ("e^{i\\pi}","-1"),
    ("a/b/c","a/(bc)"),
    ("2(x+1)","2x+2"),
    ("x^{100}-1+1","x^{100}"),
    (r"\frac{x^2-1}{x-1}","x+1"),
    ("\\sqrt[3]{8}","2"),
    ("3\\text{ cm}","3"),
    ("10^{3}","1000"),
    ("2^{3^2}","512"),
    ("sqrt(2)/2",r"\frac{1}{\sqrt{2}}"),
    ("\\ln(e^2)","2"),
    ("90^\\circ","90"),
    ("[0,1)","[0, 1)"),
    ("y","y"),
    ("\\alpha+\\beta","\\beta+\\alpha"),
    ("x_1+x_2","x_2+x_1"),
    ("- - 3","3"),
    ("1"+"0"*400,"10^{400}"),
    ("+".join(["x"]*500),"500x")]
UNEQUAL = [("1/3","0.333333333333333"),
    ("x^2","x^3"),
    ("(1,2)","(2,1)"),
    ("[0,1)","[0,1]"),
    ("{1,2}","{1,3}"),
    ("1,2","1"),
    ("a","b"),
    ("2^3^2","64"),
    ("\\sqrt{2}","1.41421356"),
    ("foo(","foo("),
    ("",""),
    ("1/0","1/0"),
    ("x+1","x"),
    ("__import__('os')","1"),
    ("\\sin x","\\cos x"),
    ("9^{9^{9^9}}","9^{9^{9^8}}"),
    ("1"+"0"*400,"10^{401}"),
    ("5!","120x")]


@pytest.mark.parametrize("a, b", EQUAL)
def test_equal(a, b):
    assert symbolic_equal(a, b) and symbolic_equal(b, a)


@pytest.mark.parametrize("a, b", UNEQUAL)
def test_unequal(a, b):
    assert not symbolic_equal(a, b) and not symbolic_equal(b, a)


def test_nesting_beyond_any_stack_is_unreadable():
    assert not symbolic_equal("(" * 100_000 + "1" + ")" * 100_000, "1")
