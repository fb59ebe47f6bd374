"""Fragments of SQL that the twins share."""

from __future__ import annotations

from ..operators.text import STOPWORDS

STOP = "(" + ",".join(f"'{w}'" for w in STOPWORDS) + ")"


def word(seed: int, keys: tuple[str, ...], at: int) -> str:
    joined = ",".join(["'%d'" % seed, *keys])
    return f"CAST(('0x'||substr(md5(concat_ws('|',{joined})),{at},8)) AS BIGINT)"


def _word(seed: int, keys: tuple[str, ...], at: int) -> str:
    return f"(({word(seed, keys, at)}::DOUBLE+0.5::DOUBLE)/4294967296.0::DOUBLE)"


def u(seed: int, *keys: str) -> str:
    return _word(seed, keys, 1)


def normal(seed: int, *keys: str) -> str:
    return f"(sqrt(-2.0*ln({_word(seed, keys, 1)}))*cos(2.0*pi()*{_word(seed, keys, 9)}))"


def r6(x: str, digits: int = 6) -> str:
    return f"(round(({x})::DOUBLE,{digits})+0.0)"


def softmax(a: str, t: str = "1.0") -> str:
    e = f"list_transform({a}, lambda x: exp((x-list_max({a}))/({t})))"
    return f"list_transform({e}, lambda y: y/list_sum({e}))"


def lse(a: str, t: str = "1.0") -> str:
    return f"(ln(list_sum(list_transform({a}, lambda x: exp((x-list_max({a}))/({t}))))))"


def argmax0(a: str) -> str:
    return f"(list_position({a}, list_max({a}))-1)"


def entropy(a: str, floor: str = "1e-12") -> str:
    return f"(-list_sum(list_transform({a}, lambda x: x*ln(greatest(x,{floor})))))"


def phi(x: str) -> str:
    a = f"(abs({x})/sqrt(2.0))"
    t = f"(1.0::DOUBLE/(1.0+0.3275911*{a}))"
    poly = f"({t}*(0.254829592::DOUBLE+{t}*(-0.284496736::DOUBLE+{t}*(1.421413741::DOUBLE+{t}*(-1.453152027::DOUBLE+{t}*1.061405429::DOUBLE)))))"
    erf = f"(1.0-{poly}*exp(-{a}*{a}))"
    return f"(CASE WHEN {x}>=0 THEN 0.5*(1.0+{erf}) ELSE 0.5*(1.0-{erf}) END)"


def bucket(qtype: str, k: str) -> str:
    return f"({qtype}||':'||CASE WHEN {k}<=2 THEN '2' WHEN {k}<=5 THEN '3-5' WHEN {k}<=10 THEN '6-10' ELSE '11+' END)"


def corr(a: str, b: str) -> str:
    return (
        f"(CASE WHEN stddev_pop({a})>1e-12 AND stddev_pop({b})>1e-12 "
        f"THEN covar_pop({a},{b})/(stddev_pop({a})*stddev_pop({b})) END)"
    )


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def ece_bin(p: str) -> str:
    return f"(CASE WHEN round({p},9)>=0 AND round({p},9)<=1 THEN greatest(ceil(round({p},9)*15),1)::BIGINT END)"
