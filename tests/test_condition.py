import ipaddress

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flumen.functions.net import cidr_range, format_ip, parse_ip
from flumen.plans.condition import And, Condition, ConditionError, Not, Or, columns_of, compile_condition, desugar, negation_normal_form, parse, resolve, tokenize


@pytest.mark.parametrize(
    "text, canonical",
    [
        ("dport = 80", "dport = 80"),
        ("DPORT EQ 80", "dport = 80"),
        ("dport==80", "dport = 80"),
        ("dport -neq 80", "dport != 80"),
        ("dport greater 80 and dport less 90", "(dport > 80 & dport < 90)"),
        ("dport=80|dport=81&proto=tcp", "(dport = 80 | (dport = 81 & proto = tcp))"),
        ("not dport = 80", "!(dport = 80)"),
        ("not{dport=80}", "!(dport = 80)"),
        ("[dport = 80 or proto = udp] * sip = ::1", "((dport = 80 | proto = udp) & sip = ::1)"),
        ("dport = 1 & dport = 2 & dport = 3", "(dport = 1 & (dport = 2 & dport = 3))"),
        ("host = g", "host = g"),
    ],
)
def test_parse(text, canonical):
    assert str(parse(text)) == canonical


@pytest.mark.parametrize("text", ["dport", "dport =", "= 80", "dport = 80 &", "(dport = 80", "dport = 80)", "!!dport = 80", "time = 3", "dport = 80 proto = 6", "dport 80", "& dport = 80", "dport = ="])
def test_rejects(text):
    with pytest.raises(ConditionError) as e:
        parse(text)
    assert "^" in str(e.value)


def test_empty_and_foreign():
    assert parse("") is None and parse("  ") is None
    with pytest.raises(ValueError):
        tokenize("sip = é")


def test_long_condition():
    assert str(parse(" | ".join(f"dport = {i}" for i in range(500)))).count("|") == 499


@pytest.mark.parametrize("text", ["dport = 65536", "dport = -1", "proto = 256", "proto = nosuch", "sip < 1.2.3.4", "snet = 1.2.3.4", "snet = 1.2.3.4/33", "dnet = ::/129", "host < 1.1.1.1", "snet >= 1.0.0.0/8"])
def test_bad_values(spark, text):
    with pytest.raises(ValueError):
        compile_condition(text)


def test_desugar():
    assert str(desugar(parse("src = 1.1.1.1"))) == "sip = 1.1.1.1"
    assert str(desugar(parse("host = 1.1.1.1"))) == "(sip = 1.1.1.1 | dip = 1.1.1.1)"
    assert str(desugar(parse("net != 1.0.0.0/8"))) == "!((snet = 1.0.0.0/8 | dnet = 1.0.0.0/8))"
    assert columns_of("net = 1.0.0.0/8 & dport = 1") == {"sip", "dip", "dport"}


def test_resolve():
    names = {"a.test": ["1.1.1.1", "2.2.2.2"]}
    assert str(resolve(parse("sip = a.test"), names.get)) == "(sip = 1.1.1.1 | sip = 2.2.2.2)"
    assert str(resolve(parse("sip != a.test"), names.get)) == "(sip != 1.1.1.1 & sip != 2.2.2.2)"
    with pytest.raises(ValueError):
        resolve(parse("sip = b.test"), names.get)


conditions = st.builds(lambda c, v: Condition("dport", c, str(v)), st.sampled_from(["=", "!=", "<", "<=", ">", ">="]), st.integers(0, 9))
trees = st.recursive(conditions, lambda t: st.one_of(st.builds(Not, t), st.builds(And, t, t), st.builds(Or, t, t)), max_leaves=12)


def evaluate(node, x):
    if isinstance(node, Condition):
        v = int(node.value)
        return {"=": x == v, "!=": x != v, "<": x < v, "<=": x <= v, ">": x > v, ">=": x >= v}[node.comparator]
    if isinstance(node, Not):
        return not evaluate(node.node, x)
    pair = evaluate(node.left, x), evaluate(node.right, x)
    return all(pair) if isinstance(node, And) else any(pair)


@given(trees)
def test_normal_form_is_equivalent(tree):
    flat = negation_normal_form(tree)
    assert "!(" not in str(flat)
    assert all(evaluate(tree, x) == evaluate(flat, x) for x in range(10))


@given(trees)
def test_text_round_trip(tree):
    assert str(parse(str(tree))) == str(tree) or "!(!(" in str(tree)


@given(st.binary(min_size=16, max_size=16), st.binary(min_size=16, max_size=16), st.integers(0, 128))
def test_cidr_range_is_mask_comparison(address, net, bits):
    low, high = cidr_range(f"{ipaddress.IPv6Address(net)}/{bits}") if "." not in str(ipaddress.IPv6Address(net)) else cidr_range(f"{ipaddress.IPv6Address(net).exploded}/{bits}")
    same = int.from_bytes(address, "big") >> (128 - bits) == int.from_bytes(net, "big") >> (128 - bits)
    assert (low <= address <= high) == same


def test_addresses():
    assert parse_ip("1.2.3.4") == bytes([1, 2, 3, 4]) + bytes(12)
    assert parse_ip("::ffff:1.2.3.4") == parse_ip("1.2.3.4")
    assert format_ip(parse_ip("2001:db8::")) == "32.1.13.184"  # twelve zero bytes print as IPv4
    assert format_ip(parse_ip("2001:db8::1")) == "2001:db8::1"
    with pytest.raises(ValueError):
        parse_ip("1.2.3")


@given(st.lists(st.sampled_from([0, 0, 0, 1, 0xABCD]), min_size=8, max_size=8))
@settings(deadline=None)
def test_format_like_library(groups):
    raw = b"".join(g.to_bytes(2, "big") for g in groups)
    if any(raw[4:]):
        expected = str(ipaddress.IPv6Address(raw))
        if "." not in expected:
            assert format_ip(raw) == expected
