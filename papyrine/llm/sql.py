"""SQL for the queries of this subpackage that can be stated in it.

The SQL engine has NFC but no NFKC, so the compatibility letters that occur in texts, the Latin
ligatures, are spelled out.  The other queries have no faithful SQL; their tests compare them with
brute force.
"""

from __future__ import annotations

_NFKC = "nfc_normalize(" + "replace(" * 5 + "abstract" + "".join(f", '{a}', '{b}')" for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))) + ")"
_TERMS = f"""with r as (select distinct event_id, abstract from papers where event_id is not null and abstract is not null),
n as (select count(distinct event_id) as n from r), t as (select event_id, unnest(regexp_extract_all(lower({_NFKC}), '\\pL+')) as term from r),
c as (select term, count(*) as occurrences, count(distinct event_id) as records from t group by 1),
m as (select term, occurrences, records, case when records <= 2 then 'rare' when records > 0.25 * n then 'common' else 'useful' end as mark from c, n)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _TERMS + " select term, mark from m where mark <> 'useful'",
        "p3_term_counts": _TERMS + " select term, occurrences, records, mark from m",
    }
