"""Generators of the SQL that ranking and clustering must agree with. Written for DuckDB, from the rules alone."""

from __future__ import annotations

from .. import constants as C


def grams(text: str) -> str:
    """A list of a text's character 2- to 4-grams, each word padded."""
    words = f"list_filter(regexp_split_to_array(replace(lower({text}), 'ß', 'ss'), '\\s+'), lambda w: w <> '')"
    each = " , ".join(f"flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + {4 - z}), lambda i: substr(' ' || w || ' ', i, {z}))))" for z in (2, 3, 4))
    return f"flatten([{each}])"


def similarity(source: str, key: str, text: str, query: str, name: str) -> str:
    """CTEs that end in `name`(key, similarity)."""
    return f"""{name}_d as (select {key} k, {text} t from {source} union all select null, '{query}'),
{name}_c as (select k, term, count(*) n from (select k, unnest({grams("t")}) term from {name}_d) group by all),
{name}_i as (select term, ln((1 + (select count(*) from {name}_d)) / (1 + count(*))) + 1 idf from {name}_c group by term),
{name}_w as (select k, c.term, n * idf w from {name}_c c join {name}_i i on c.term = i.term),
{name}_q as (select term, w from {name}_w where k is null),
{name}_n as (select sqrt(sum(w * w)) n from {name}_q),
{name}_s as (select a.k, sum(a.w * coalesce(q.w, 0)) / (sqrt(sum(a.w * a.w)) * (select n from {name}_n)) s from {name}_w a left join {name}_q q on a.term = q.term where a.k is not null group by a.k),
{name} as (select {key} k, coalesce(s, 0)::double similarity from {source} left join {name}_s on k = {key})"""


def clusters(source: str, key: str, features: list[str], k: int, name: str, rounds: int = 30) -> str:
    """CTEs that end in `name`(k, cluster_name) for at least k unlike rows; `name`_z has k, x0.. and z0.."""
    r = range(len(features))
    out = f"""{name}_m as (select {", ".join(f"median({f}::double) m{i}, 0 z{i}" for i, f in enumerate(features))} from {source}),
{name}_x as (select {key} k, {", ".join(f"coalesce({f}::double, m{i}, 0) x{i}" for i, f in enumerate(features))} from {source}, {name}_m),
{name}_t as (select {", ".join(f"avg(x{i}) a{i}, case when stddev_pop(x{i}) = 0 then 1 else stddev_pop(x{i}) end s{i}" for i in r)} from {name}_x),
{name}_z as materialized (select k, {", ".join(f"x{i}, (x{i} - a{i}) / s{i} z{i}" for i in r)}, row_number() over (order by x0, k) - 1 pos, count(*) over () n from {name}_x, {name}_t),
{name}_0 as materialized (select g, {", ".join(f"z{i} v{i}" for i in r)} from {name}_z join (select range::int g from range({k})) on pos = round_even(g * (n - 1) / {max(1, k - 1)}.0, 0))"""
    near = lambda i: f"select z.k, arg_min(g, {' + '.join(f'(z{j} - v{j}) * (z{j} - v{j})' for j in r)}) g from {name}_z z, {name}_{i} group by z.k"
    for i in range(rounds - 1):
        out += f""",
{name}_{i + 1} as materialized (select o.g, {", ".join(f"coalesce(n.v{j}, o.v{j}) v{j}" for j in r)} from {name}_{i} o left join (select g, {", ".join(f"avg(z{j}) v{j}" for j in r)} from ({near(i)}) l join {name}_z z on z.k = l.k group by g) n on n.g = o.g)"""
    return out + f""",
{name}_l as materialized ({near(rounds - 1)}),
{name}_r as (select g, row_number() over (order by avg(x0), g) r, count(*) over () n from {name}_l l join {name}_z z on z.k = l.k group by g),
{name} as (select l.k, case when r = n then '{C.HEARTY}' when r = 1 then '{C.LIGHT}' else '{C.MIDDLE}' end cluster_name from {name}_l l join {name}_r r on r.g = l.g)"""


def case_types(text: str, types: dict) -> str:
    has = lambda words: " or ".join(f"contains(lower({text}), '{w}')" for w in words)
    return "list_filter([" + ", ".join(f"case when {has(w)} then '{n}' end" for n, w in types.items()) + "], lambda c: c is not null)"


def case_spice(text: str, levels: dict) -> str:
    has = lambda words: " or ".join(f"contains(lower({text}), '{w}')" for w in words)
    return "case " + " ".join(f"when {has(levels[n])} then {n}" for n in sorted(levels, reverse=True)) + " else 2 end"


def ranking(clean: str, key: str, p, rules, name: str, top: int, shared: dict | None = None) -> str:
    """CTEs over `clean` that end in `name`: the `top` best rows for profile p. shared: by allergy set the name under which
    an earlier ranking made its safe rows and clusters."""
    features = ["calories", "carbs_g", "protein_g", "fat_g", "dish_count"]
    of = name if shared is None else shared.setdefault(p.allergy_codes, name)
    safe = f"{of}_safe as materialized (select * from {clean}" + (f" where not list_has_any(allergy_codes, {list(p.allergy_codes)})" if p.allergy_codes else "") + ")"
    count = lambda terms: " + ".join([f"contains(lower(menu_text), '{t}')::int" for t in terms] or ["0"])
    named = lambda terms, label: "case when " + (" or ".join([f"contains(lower(menu_text), '{t}')" for t in terms] or ["false"])) + f" then '{label}' || array_to_string(list_filter({list(terms) or ['']}, lambda t: contains(lower(menu_text), t)), ', ') end"
    kinds = f"list_filter({list(p.preferred_types) or ['']}, lambda c: list_contains({case_types('menu_text', rules.types)}, c))"
    first = [safe, clusters(f"{of}_safe", key, features, 3, f"{of}_km")] if of == name else []
    return f"""{", ".join([*first, similarity(f"{of}_safe", key, "menu_text", p.query(), f"{name}_sim")])},
{name}_p as (select s.*, similarity, cluster_name, {count(p.likes)} nl, {count(p.avoids)} na, {kinds} kinds, abs({p.spice_level} - {case_spice("menu_text", rules.spice)}) sp
  from {of}_safe s join {name}_sim m on m.k = {key} join {of}_km c on c.k = {key}),
{name}_v as (select *, round(greatest(0, least(100, 20 + 70 * similarity + 8 * nl + 5 * len(kinds) - 18 * na - 3 * sp)), 1)::double score,
  concat_ws(' · ', '{C.REASONS["similarity"]}' || printf('%.2f', similarity), {named(p.likes, C.REASONS["likes"])}, case when len(kinds) > 0 then '{C.REASONS["types"]}' || array_to_string(kinds, ', ') end, {named(p.avoids, C.REASONS["avoids"])}, '{C.REASONS["spice"]}' || sp::varchar) reason from {name}_p),
{name} as (select *, row_number() over (order by score desc, date, {key}) rank from {name}_v qualify rank <= {top})"""
