"""The published Porter2 algorithm as DuckDB SQL, by which queries over stems are checked."""

from __future__ import annotations

from quaestor.functions import stem as S
from quaestor.functions.text import duck_stopwords

_V, _C = "[aeiouy]", "[^aeiouy]"


def _cut(n: int, word: str = "w") -> str:
    return f"substr({word}, 1, length({word}) - {n})"


def _suffixes(table, room: dict[str, str], default: str) -> str:
    """One step of suffixes: the first that fits decides; room gives conditions of single suffixes."""
    cases = []
    for suffix, new in table:
        start = f"length(w) - {len(suffix)}"
        cases.append(f"when ends_with(w, '{suffix}') then case when {start} >= {default}{room.get(suffix, '')} then {_cut(len(suffix))} || '{new}' else w end")
    return "case " + " ".join(cases) + " else w end"


def _short(word: str) -> str:
    return f"regexp_matches({word}, '^{_V}{_C}$|{_C}{_V}[^aeiouywxY]$')"


def stem_ctes(source: str) -> str:
    """CTEs up to stems (word, stem), of the words of a CTE source (word); words are lower-case and have no apostrophe."""
    special = " ".join(f"when word = '{k}' then '{v}'" for k, v in S._SPECIAL.items())
    late = ", ".join(f"'{w}'" for w in S._LATE)
    step2 = _suffixes(S._STEP2, {"ogi": f" and ends_with({_cut(3)}, 'l')", "li": f" and regexp_matches({_cut(2)}, '[cdeghkmnrt]$')"}, "r1")
    step3 = _suffixes(S._STEP3, {"ative": " and length(w) - 5 >= r2"}, "r1")
    step4 = _suffixes([(s, "") for s in S._STEP4], {"ion": f" and regexp_matches({_cut(3)}, '[st]$')"}, "r2")
    first = "^" + _C + "*" + _V + "+" + _C
    return f"""s_marked as (select distinct word, regexp_replace(word, '(^|{_V})y', '\\1Y', 'g') as w from {source}),
  s_r1 as (select *, case when starts_with(w, 'gener') or starts_with(w, 'arsen') then 5 when starts_with(w, 'commun') then 6
    when regexp_matches(w, '{first}') then length(regexp_extract(w, '{first}')) else length(w) end as r1 from s_marked),
  s_r2 as (select *, case when regexp_matches(substr(w, r1 + 1), '{first}') then r1 + length(regexp_extract(substr(w, r1 + 1), '{first}')) else length(w) end as r2 from s_r1),
  s_plural as (select word, r1, r2, case when ends_with(w, 'sses') then {_cut(2)} when ends_with(w, 'ied') or ends_with(w, 'ies') then case when length(w) > 4 then {_cut(2)} else {_cut(1)} end
    when ends_with(w, 's') and not ends_with(w, 'us') and not ends_with(w, 'ss') and regexp_matches({_cut(2)}, '{_V}') then {_cut(1)} else w end as w from s_r2),
  s_late as (select *, w in ({late}) as late, regexp_extract(w, '(eedly|eed|ingly|edly|ing|ed)$') as m from s_plural),
  s_start as (select *, substr(w, 1, length(w) - length(m)) as b from s_late),
  s_past as (select word, r1, r2, late, case when late or m = '' then w when m in ('eed', 'eedly') then case when length(b) >= r1 then b || 'ee' else w end
    when not regexp_matches(b, '{_V}') then w when regexp_matches(b, '(at|bl|iz)$') then b || 'e' when regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') then {_cut(1, "b")}
    when length(b) <= r1 and {_short("b")} then b || 'e' else b end as w from s_start),
  s_y as (select word, r1, r2, late, case when not late and regexp_matches(w, '.{_C}[yY]$') then {_cut(1)} || 'i' else w end as w from s_past),
  s_2 as (select word, r1, r2, late, case when late then w else {step2} end as w from s_y),
  s_3 as (select word, r1, r2, late, case when late then w else {step3} end as w from s_2),
  s_4 as (select word, r1, r2, late, case when late then w else {step4} end as w from s_3),
  s_e as (select word, case when late then w when ends_with(w, 'e') then case when length(w) - 1 >= r2 or length(w) - 1 >= r1 and not {_short(_cut(1))} then {_cut(1)} else w end
    when ends_with(w, 'll') and length(w) - 1 >= r2 then {_cut(1)} else w end as w from s_4),
  stems as (select word, case when length(word) < 3 or word in ({duck_stopwords()}) then word {special} else lower(w) end as stem from s_e)"""
