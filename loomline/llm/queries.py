"""The queries of this subpackage, and SQL for those that SQL expresses."""

from __future__ import annotations

from loomline.llm.alignment import op13_alignment
from loomline.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from loomline.llm.lattice import op5_lattice
from loomline.llm.media import op12_png
from loomline.llm.minhash import op1_minhash
from loomline.llm.ordinal import op10_ordinal
from loomline.llm.packing import op6_packing
from loomline.llm.passages import op4_passages
from loomline.llm.quality_rules import op2_quality_rules
from loomline.llm.secrets import op3_secrets
from loomline.llm.sharding import op7_jump_hash
from loomline.llm.url_filter import ENDINGS, SITES, op9_url_filter
from loomline.llm.winnowing import op8_winnowing

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_quality_rules": op2_quality_rules,
    "op3_secrets": op3_secrets,
    "op4_passages": op4_passages,
    "op5_lattice": op5_lattice,
    "op6_packing": op6_packing,
    "op7_jump_hash": op7_jump_hash,
    "op8_winnowing": op8_winnowing,
    "op9_url_filter": op9_url_filter,
    "op10_ordinal": op10_ordinal,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_png": op12_png,
    "op13_alignment": op13_alignment,
}

ORACLES: dict[str, str] = {
    "op9_url_filter": rf"""
        with p as (
            select page_id, url, nullif(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '') as article,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
            from pages
        ), bare as (
            select *, regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$|\.$', ''), '^www\.', '') as site,
                   regexp_replace(regexp_replace(regexp_replace(path, '/(index\.html?)?$', ''), '/{{2,}}', '/', 'g'), '^/', '') as page
            from p
        ), listed as (
            select site || '.example.' || ending || '/' as key from unnest({list(SITES)}) as s(site), unnest({list(ENDINGS)}) as e(ending)
            union
            select site || '/' || page from bare join (select article, min(page_id) as first from p group by article) using (article)
            where page_id > first and url is not null and site || page <> ''
        ), keys as (
            select page_id, url, site || '/' || page as key from bare where host <> ''
            union all
            select page_id, url, array_to_string(labels[i:], '.') || '/'
            from (select page_id, url, string_split(site, '.') as labels from bare where host <> ''), range(1, 64) as n(i)
            where i <= greatest(len(labels) - 1, 1)
        ), blocked as (
            select distinct page_id, url from keys semi join listed using (key)
        ), r as (
            select *, case
                when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
                when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
                when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
                when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/'
            end as rule
            from p
        )
        select page_id, host, path, rule,
               case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
                    when blocked.url is not null then 'block' else 'allow' end as verdict
        from r left join blocked using (page_id, url)
    """,
    "op11_hard_negatives": OP11_SQL,
}
