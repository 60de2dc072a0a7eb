"""DuckDB SQL with the results the queries must give, written from their definitions."""

from __future__ import annotations

from itertools import combinations

from checks import views

# column name -> kind, in table order
COLUMNS = {
    "nation": {"n_nationkey": "int", "n_name": "text", "n_regionkey": "int"},
    "dup_nation": {"n_nationkey": "int", "n_name": "text", "n_regionkey": "int"},
    "customer": {
        "c_custkey": "int",
        "c_name": "text",
        "c_nationkey": "int",
        "c_acctbal": "double",
        "c_mktsegment": "text",
    },
    "dirty_customer": {
        "c_custkey": "int",
        "name": "text",
        "code_text": "text",
        "date_text": "text",
        "acctbal": "double",
        "constant_value": "double",
        "spiky": "double",
        "all_null": "text",
        "code_shape": "text",
    },
    "supplier": {"s_suppkey": "int", "s_name": "text", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {
        "p_partkey": "int",
        "p_name": "text",
        "p_brand": "text",
        "p_type": "text",
        "p_size": "int",
        "p_retailprice": "double",
    },
    "orders": {
        "o_orderkey": "int",
        "o_custkey": "int",
        "o_orderstatus": "text",
        "o_totalprice": "double",
        "o_orderdate": "time",
        "o_orderpriority": "text",
    },
    "lineitem": {
        "l_orderkey": "int",
        "l_partkey": "int",
        "l_suppkey": "int",
        "l_linenumber": "int",
        "l_quantity": "double",
        "l_extendedprice": "double",
        "l_discount": "double",
        "l_tax": "double",
        "l_returnflag": "text",
        "l_linestatus": "text",
        "l_shipdate": "time",
    },
    "events": {
        "event_id": "int",
        "ts": "time",
        "user_id": "int",
        "event_type": "text",
        "value": "double",
        "props": "text",
    },
    "documents": {
        "doc_id": "int",
        "text": "text",
        "lang": "text",
        "source": "text",
        "n_chars": "int",
    },
    "embeddings": {"vec_id": "int", "embedding": "nested", "label": "int"},
}

INT32 = {"n_nationkey", "n_regionkey", "c_nationkey", "s_nationkey", "p_size", "l_linenumber", "label"}

ORDER = {
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "dirty_customer": "c_custkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "events": "event_id",
}


def _filled(text: str) -> str:
    names = "region nation customer supplier part orders lineitem events documents conversations"
    return text.format(**{n: n for n in names.split()})


WITH_VIEWS = (
    f"dirty_customer as ({_filled(views.DIRTY_CUSTOMER)}), "
    f"dup_nation as ({_filled(views.DUP_NATION)})"
)


def _union(parts: list[str], more: str = "") -> str:
    ctes = WITH_VIEWS + (", " + more if more else "")
    return f"with {ctes} " + " union all ".join(f"({p})" for p in parts)


def _each(tables: str, kinds: tuple[str, ...] | None = None):
    for table in tables.split():
        for no, (column, kind) in enumerate(COLUMNS[table].items(), start=1):
            if kinds is None or kind in kinds:
                yield table, no, column, kind


NUMERIC = ("int", "double")
FLAT = ("int", "double", "text", "time")

DATE_FORMATS = (
    "%Y-%m-%d",
    "%Y-%m-%d %H:%M",
    "%Y-%m-%d %H:%M:%S",
    "%Y/%m/%d",
    "%m/%d/%Y",
    "%d/%m/%Y",
    "%d.%m.%Y",
)


# ---- dictionary ----------------------------------------------------------------


def _dictionary_row(table: str, column: str, kind: str) -> str:
    """data_type, total_rows, null_count, error_count, blank_count of one column."""
    label = {"int": "integer", "double": "decimal", "time": "date/time", "nested": "nested"}.get(kind)
    if label:
        return (
            f"select '{label}' as data_type, count(*) as total_rows, "
            f"count(*) - count({column}) as null_count, 0 as error_count, 0 as blank_count from {table}"
        )
    dates = ", ".join(
        f"count(*) filter (where try_strptime({column}, '{f}') is not null)" for f in DATE_FORMATS
    )
    return f"""
    select case when present = 0 then 'unknown (all blank)'
                when numbers / present > 0.9 then 'numeric (stored as text)'
                when dates / present > 0.9 then 'date (stored as text)' else 'text' end as data_type,
           total_rows, total_rows - present as null_count,
           case when present = 0 then 0 when numbers / present > 0.9 then present - numbers
                when dates / present > 0.9 then present - dates else 0 end as error_count,
           blank_count
    from (select count(*) as total_rows, count({column}) as present,
                 count(*) filter (where try_cast({column} as double) is not null) as numbers,
                 greatest({dates}) as dates,
                 count(*) filter (where trim({column}) = '') as blank_count from {table})"""


def data_dictionary() -> str:
    tables = "customer orders dirty_customer dup_nation embeddings"
    parts = []
    for slno, (table, no, column, kind) in enumerate(_each(tables), start=1):
        table_no = tables.split().index(table) + 1
        parts.append(
            f"select {slno} as slno, {table_no} as table_no, '{table}' as table_name, "
            f"{no} as column_no, '{column}' as column_name, * from ({_dictionary_row(table, column, kind)})"
        )
    return _union(parts)


def dtype_labels() -> str:
    return _union(
        [
            f"select '{t}' as table_name, '{c}' as column_name, data_type from ({_dictionary_row(t, c, k)})"
            for t, _, c, k in _each("dirty_customer part lineitem events documents")
        ]
    )


# ---- keys ----------------------------------------------------------------------


def cardinality() -> str:
    return _union(
        [
            f"select '{t}' as table_name, '{c}' as column_name, count(distinct {c}) as distinct_count from {t}"
            for t, _, c, _ in _each("dirty_customer dup_nation lineitem events", FLAT)
        ]
    )


def _duplicates(table: str) -> str:
    return f"(select count(*) from {table}) - (select count(*) from (select distinct * from {table}))"


def duplicate_rows() -> str:
    return _union(
        [
            f"select '{t}' as table_name, {_duplicates(t)} as duplicate_rows"
            for t in "dup_nation orders lineitem documents".split()
        ]
    )


def key_candidates() -> str:
    return _union(
        [
            f"select '{t}' as table_name, '{c}' as column_name, count(distinct {c}) as distinct_count, "
            f"{_duplicates(t)} as duplicate_rows, "
            f"case when count(distinct {c}) = count(*) and count(*) > 0 then 'YES' else '' end "
            f"as primary_key_candidate from {t}"
            for t, _, c, _ in _each("nation dup_nation dirty_customer orders part", FLAT)
        ]
    )


# ---- description ---------------------------------------------------------------


def _shown(column: str, kind: str) -> str:
    return f"coalesce(cast({column} as varchar), '')"


def _mode(table: str, column: str) -> str:
    """A scalar query: the mode text of one column."""
    return f"""(select coalesce(string_agg(case when rn <= 3 then cast(v as varchar) end, ', ' order by rn)
                  || case when count(*) > 3 then ' ...' else '' end, 'N/A')
        from (select v, row_number() over (order by v) as rn
              from (select {column} as v, count(*) as n from {table} where {column} is not null group by 1
                    qualify n = max(n) over ())))"""


def column_mode() -> str:
    return _union(
        [
            f"select '{t}' as table_name, '{c}' as column_name, {_mode(t, c)} as mode"
            for t, _, c, _ in _each("dirty_customer dup_nation orders lineitem", FLAT)
        ]
    )


def decimal_modes() -> str:
    rows = " union all ".join(
        f"select 'priced' as table_name, '{c}' as column_name, {_mode('priced', c)} as mode" for c in ("ids", "halves", "price", "size")
    )
    return f"with priced as ({_filled(views.PRICED)}) {rows}"


def numeric_summary() -> str:
    return _union(
        [
            f"select '{t}' as table_name, '{c}' as column_name, round(avg({c}), 3) as mean, "
            f"round(cast(median({c}) as double), 3) as median, "
            f"round(cast(max({c}) - min({c}) as double), 3) as value_range from {t}"
            for t, _, c, _ in _each("dirty_customer orders lineitem", NUMERIC)
        ]
    )


def quartiles() -> str:
    return _union(
        [
            f"select '{t}' as table_name, '{c}' as column_name, count({c}) as n, "
            f"quantile_cont(cast({c} as double), 0.25) as q1, "
            f"quantile_cont(cast({c} as double), 0.75) as q3 from {t}"
            for t, _, c, _ in _each("dirty_customer orders lineitem events", NUMERIC)
        ]
    )


def _bounds(table: str, column: str) -> str:
    """One row with n, q1, q3, low and high."""
    return (
        f"select *, q1 - 1.5 * (q3 - q1) as low, q3 + 1.5 * (q3 - q1) as high from "
        f"(select count({column}) as n, quantile_cont(cast({column} as double), 0.25) as q1, "
        f"quantile_cont(cast({column} as double), 0.75) as q3 from {table})"
    )


def _half_up(value: str, digits: int) -> str:
    """Rounding on the decimal text; round(double) works on a scaled binary value."""
    return f"cast(round(cast(cast({value} as varchar) as decimal(38, 15)), {digits}) as double)"


def outlier_report() -> str:
    return _union(
        [
            f"select '{t}' as table_name, '{c}' as column_name, {_half_up('any_value(low)', 2)} as range_low, "
            f"{_half_up('any_value(high)', 2)} as range_high, "
            f"count(*) filter (where {c} < low or {c} > high) as outlier_count, "
            f"round(count(*) filter (where {c} < low or {c} > high) / any_value(b.n) * 100.0, 2) "
            f"as outlier_percent from {t}, ({_bounds(t, c)}) b having any_value(b.n) >= 4"
            for t, _, c, _ in _each("dirty_customer orders lineitem events", NUMERIC)
        ]
    )


def outlier_rows() -> str:
    return (
        f"select event_id, event_type, value from events, ({_bounds('events', 'value')}) b "
        "where value < low or value > high"
    )


def _examples(table: str, column: str) -> str:
    """A scalar query: the outlier text of one column."""
    return f"""(select case when any_value(n) < 4 then 'N/A' when any_value(q1) = any_value(q3) then 'None'
              when count(*) filter (where beyond) = 0 then 'None'
              else count(*) filter (where beyond) || ' found (e.g. '
                   || string_agg(case when beyond and rn <= 3 then cast(round(v, 2) as varchar) end, ', ' order by rn)
                   || ')' end
        from (select *, row_number() over (partition by beyond order by k) as rn
              from (select {ORDER[table]} as k, cast({column} as double) as v, b.*,
                           coalesce({column} < low or {column} > high, false) as beyond
                    from {table}, ({_bounds(table, column)}) b)))"""


def outlier_examples() -> str:
    return _union(
        [
            f"select '{t}' as table_name, '{c}' as column_name, {_examples(t, c)} as outliers"
            for t, _, c, _ in _each("dirty_customer part events", NUMERIC)
        ]
    )


def _first_rows(table: str, column: str, kind: str) -> str:
    cells = ", ".join(
        f"coalesce(max(case when rn = {i} then {_shown(column, kind)} end), '') as row_{i}"
        for i in range(1, 5)
    )
    return (
        f"select {cells} from (select {column}, row_number() over (order by {ORDER[table]}) as rn from {table})"
    )


def first_rows() -> str:
    return _union(
        [
            f"select '{c}' as column_name, *, '{t}' as table_name from ({_first_rows(t, c, k)})"
            for t, _, c, k in _each("nation dirty_customer orders events", FLAT)
        ]
    )


def _described_numbers(table: str, column: str) -> str:
    return (
        f"(select cast(round(avg({column}), 3) as varchar) from {table}) as mean, "
        f"(select cast(round(cast(median({column}) as double), 3) as varchar) from {table}) as median, "
        f"(select cast(round(cast(max({column}) - min({column}) as double), 3) as varchar) from {table}) "
        f"as value_range, {_examples(table, column)} as outliers"
    )


def describe_failing() -> str:
    """The readable columns as in describe_table, fixed rows for the two that fail."""
    none = "'N/A' as mean, 'N/A' as median, 'N/A' as value_range"
    kinds = {c: k for _, _, c, k in _each("orders", FLAT)}
    blank = ", ".join(f"'' as row_{i}" for i in range(1, 5))
    parts = []
    for no, name, kind in (
        (1, "o_orderkey", "bigint"),
        (2, "band", "int"),
        (3, "o_totalprice", "double"),
        (4, "open_status", "string"),
        (5, "o_orderstatus", "string"),
    ):
        if name in kinds:
            source, mode = f"({_first_rows('orders', name, kinds[name])}) r", _mode("orders", name)
            numbers = f"{none}, 'N/A' as outliers" if kind == "string" else _described_numbers("orders", name)
        else:
            source, mode = f"(select {blank}) r", "'N/A'"
            numbers = f"{none}, 'N/A (USER_RAISED_EXCEPTION)' as outliers"
        parts.append(
            "select 'failing' as table_name, (select count(*) from orders) as table_rows, 5 as table_columns, "
            f"{no} as column_no, '{name}' as column_name, '{kind}' as data_type, r.*, {mode} as mode, {numbers} "
            f"from {source}"
        )
    return _union(parts)


def describe_table() -> str:
    types = {"double": "double", "text": "string", "time": "timestamp_ntz"}
    parts = []
    for t, no, c, k in _each("dirty_customer events", FLAT):
        kind = types.get(k) or ("int" if c in INT32 else "bigint")
        if k in NUMERIC:
            numbers = _described_numbers(t, c)
        else:
            numbers = "'N/A' as mean, 'N/A' as median, 'N/A' as value_range, 'N/A' as outliers"
        parts.append(
            f"select '{t}' as table_name, (select count(*) from {t}) as table_rows, "
            f"{len(COLUMNS[t])} as table_columns, {no} as column_no, '{c}' as column_name, "
            f"'{kind}' as data_type, r.*, {_mode(t, c)} as mode, {numbers} "
            f"from ({_first_rows(t, c, k)}) r"
        )
    return _union(parts)


def correlation_report() -> str:
    parts = []
    for table in "dirty_customer part orders lineitem".split():
        names = [c for _, _, c, _ in _each(table, NUMERIC)]
        parts += [
            f"select '{table}' as table_name, '{a}' as column_1, '{b}' as column_2, "
            f"case when isnan(r) then null else round(r, 3) + 0.0 end as correlation "
            f"from (select corr({a}, {b}) as r from {table})"
            for a, b in combinations(names, 2)
        ]
    return _union(parts)


def correlation_wide() -> str:
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", *[f"w{i}" for i in range(1, 11)]]
    rows = " union all ".join(
        [
            f"select 'wide' as table_name, '{a}' as column_1, '{b}' as column_2, "
            f"case when isnan(r) then null else round(r, 3) + 0.0 end as correlation "
            f"from (select corr({a}, {b}) as r from wide)"
            for a, b in combinations(names, 2)
        ]
    )
    return f"with wide as ({_filled(views.WIDE)}) {rows}"


# ---- similarity ----------------------------------------------------------------

RELATED = "nation customer orders supplier"


def _match(column: str, kind: str) -> str:
    if kind == "double":
        return (
            f"case when {column} = floor({column}) then cast(cast({column} as bigint) as varchar) "
            f"else cast({column} as varchar) end"
        )
    return f"lower(trim({column}))" if kind == "text" else f"lower(cast({column} as varchar))"


def _value_ctes(tables: str, limit: int | None) -> str:
    """cols(pos, t, c) and vals(pos, v): the (sampled) values of all columns."""
    columns = list(_each(tables, FLAT))
    rows = ", ".join(
        f"({pos}, {tables.split().index(t)}, '{t}', '{c}')" for pos, (t, _, c, _) in enumerate(columns, start=1)
    )
    values = " union ".join(
        f"select {pos} as pos, {_match(c, k)} as v from {t} where {c} is not null"
        for pos, (t, _, c, k) in enumerate(columns, start=1)
    )
    picked = "select * from all_values"
    if limit:
        picked += f" qualify row_number() over (partition by pos order by md5(v), v) <= {limit}"
    return (
        f"cols(pos, tno, t, c) as (values {rows}), all_values as materialized ({values}), "
        f"vals as materialized ({picked})"
    )


def _marked(text: str, inside: str, mark: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({text}, '([{inside}]+|[^{inside}]+)'), "
        f"lambda x: case when regexp_matches(x, '^[{inside}]') then '{mark}' || length(x) else x end), '')"
    )


SHAPES = (
    "shapes as materialized (select distinct pos, "
    + _marked(_marked("v", "A-Za-z", "L"), "0-9", "D")
    + " as v from vals)"
)


def value_sample() -> str:
    return (
        f"with {_value_ctes(RELATED, 500)} select t as table_name, c as column_name, v as value "
        "from vals join cols using (pos)"
    )


def value_patterns() -> str:
    return (
        f"with {WITH_VIEWS}, {_value_ctes('dirty_customer ' + RELATED, None)}, {SHAPES} "
        "select t as table_name, c as column_name, v as shape from shapes join cols using (pos)"
    )


PAIRS = (
    "pairs as (select a.pos as p1, b.pos as p2, a.t as t1, a.c as c1, b.t as t2, b.c as c2 "
    "from cols a join cols b on a.pos < b.pos and a.tno <> b.tno)"
)


def column_pairs() -> str:
    return (
        f"with {_value_ctes(RELATED, None)}, {PAIRS}, "
        "sizes as (select pos, count(*) as n from vals group by pos) "
        "select t1 as table_name_1, c1 as column_name_1, t2 as table_name_2, c2 as column_name_2, "
        "a.n as n_1, b.n as n_2 from pairs join sizes a on a.pos = p1 join sizes b on b.pos = p2"
    )


def value_overlap() -> str:
    return (
        f"with {_value_ctes(RELATED, None)}, {PAIRS} "
        "select t1 as table_name_1, c1 as column_name_1, t2 as table_name_2, c2 as column_name_2, "
        "count(*) as common from pairs join vals a on a.pos = p1 join vals b on b.pos = p2 and a.v = b.v "
        "group by all"
    )


def _jaccard_cte(name: str, source: str) -> str:
    """name(p1, p2, pct): Jaccard percent of all pairs."""
    return f"""{name}_n as (select pos, count(*) as n from {source} group by pos),
    {name}_c as (select a.pos as p1, b.pos as p2, count(*) as common
                 from {source} a join {source} b on a.v = b.v and a.pos < b.pos group by all),
    {name} as (select p.p1, p.p2,
                 coalesce(cast(common as double) / (x.n + y.n - common) * 100.0, 0.0) as pct
               from pairs p left join {name}_c c on c.p1 = p.p1 and c.p2 = p.p2
               left join {name}_n x on x.pos = p.p1 left join {name}_n y on y.pos = p.p2)"""


def jaccard() -> str:
    return (
        f"with {_value_ctes(RELATED, None)}, {PAIRS}, {_jaccard_cte('j', 'vals')} "
        "select t1 as table_name_1, c1 as column_name_1, t2 as table_name_2, c2 as column_name_2, "
        "round(pct, 1) as value_percent from pairs join j using (p1, p2)"
    )


def _lcs_ctes(source: str) -> str:
    """lcs(a, b, n) for the distinct (a, b) of source, one table row per step."""
    return f"""ab as (select distinct a, b from {source}),
    lcs_step(a, b, i, line) as (
        select a, b, 0, list_transform(range(length(b) + 1), lambda x: 0) from ab
        union all
        select a, b, i + 1,
               list_transform(range(length(b) + 1), lambda m: coalesce(list_max(list_transform(range(m),
                   lambda j: case when substr(b, j + 1, 1) = substr(a, i + 1, 1) then line[j + 1] + 1
                                  else line[j + 2] end)), 0))
        from lcs_step where i < length(a)),
    lcs as (select a, b, line[length(b) + 1] as n from lcs_step where i = length(a))"""


def _tokens(text: str) -> str:
    return f"array_to_string(list_sort(string_split({text}, ' ')), ' ')"


def column_similarity() -> str:
    return f"""with recursive {_value_ctes(RELATED, None)}, {SHAPES}, {PAIRS},
    {_jaccard_cte('v', 'vals')}, {_jaccard_cte('s', 'shapes')},
    names as (select c1 as a, c2 as b from pairs), {_lcs_ctes('names')},
    scored as (select pairs.*, 200.0 * cast(lcs.n as double) / (length(c1) + length(c2)) as name_pct,
                      v.pct as value_pct, s.pct as shape_pct
               from pairs join v using (p1, p2) join s using (p1, p2) join lcs on a = c1 and b = c2),
    matched as (select *, cast(0.4 as double) * name_pct
                          + cast(0.6 as double) * greatest(value_pct, shape_pct) as match from scored)
    select t1 as table_1, c1 as column_1, t2 as table_2, c2 as column_2,
           round(name_pct, 1) as name_similarity, round(value_pct, 1) as value_similarity,
           round(shape_pct, 1) as pattern_similarity, round(match, 1) as match_percent,
           case when match >= 70 and value_pct >= 50 then 'possible key / FK match'
                when match >= 70 then 'same format/pattern, values differ - verify'
                when match >= 50 then 'worth reviewing' else 'weak match' end as likely_relationship
    from matched where match >= 30"""


def name_similarity() -> str:
    return f"""with recursive names as (select {_tokens('p_name')} as a, {_tokens('lower(p_type)')} as b,
                                          p_partkey from part),
    {_lcs_ctes('names')}
    select p_partkey, round(case when a = b then 100.0
                                 else 200.0 * lcs.n / (length(a) + length(b)) end, 6) as similarity
    from names join lcs using (a, b)"""


# ---- clusters ------------------------------------------------------------------

CLUSTERED = "customer supplier part"


def _cluster_ctes() -> str:
    """centre(t, c, k, cs) and score(t, c, k, s): fits and their silhouettes. Clusters are intervals:
    distances in the own one follow from running sums, those to another are to its mean."""
    values = " union all ".join(
        f"select '{t}' as t, '{c}' as c, cast({c} as double) as v, count(*) as n from {t} "
        f"where {c} is not null group by all"
        for t, _, c, _ in _each(CLUSTERED, NUMERIC)
    )
    return f"""h as materialized ({values}),
    usable as (select t, c, list(v order by v) as vs from h group by all
               having sum(n) >= 10 and count(*) >= 3),
    lloyd(t, c, k, i, cs, old) as (
        select t, c, k, 0, list_transform(range(k), lambda j:
                   round(vs[1 + cast(floor((2 * j + 1) / (2 * k) * (len(vs) - 1)) as bigint)]
                         + ((2 * j + 1) / (2 * k) * (len(vs) - 1)
                            - floor((2 * j + 1) / (2 * k) * (len(vs) - 1)))
                           * (vs[least(len(vs), 2 + cast(floor((2 * j + 1) / (2 * k) * (len(vs) - 1)) as bigint))]
                              - vs[1 + cast(floor((2 * j + 1) / (2 * k) * (len(vs) - 1)) as bigint)]), 9)), cast([] as double[])
        from usable, (select unnest(range(2, 7)) as k)
        union all
        select t, c, k, i, list(centre order by j), any_value(before)
        from (select l.t, l.c, l.k, l.i + 1 as i, j, any_value(l.cs) as before,
                     coalesce(round(fsum(h.v * h.n) / sum(h.n), 9), any_value(l.cs[j])) as centre
              from (select *, unnest(range(1, k + 1)) as j from lloyd where cs <> old) l
              left join h on h.t = l.t and h.c = l.c
                   and (l.j = 1 or h.v > (l.cs[l.j - 1] + l.cs[l.j]) / 2)
                   and (l.j = l.k or h.v <= (l.cs[l.j] + l.cs[l.j + 1]) / 2)
              group by all)
        group by all),
    centre as materialized (select t, c, k, cs from lloyd where cs = old),
    placed as materialized (
        select t, c, k, v, n, len(list_filter(range(1, k), lambda j: v > (cs[j] + cs[j + 1]) / 2)) as cl
        from centre join h using (t, c)),
    filled as (select t, c, k from placed group by all having count(distinct cl) = k),
    labelled as materialized (select placed.* from placed join filled using (t, c, k)),
    means as (select t, c, k, cl, fsum(n * v) / sum(n) as mean, sum(n) as own_size from labelled group by all),
    ahead as (select t, c, k, cl, v, n, v - mean as x, mean, own_size,
                     sum(n) over w as n_upto, sum(n * (v - mean)) over w as s_upto
              from labelled join means using (t, c, k, cl) window w as (partition by t, c, k, cl order by v)),
    ab as (select a.t, a.c, a.k, a.v, a.n, a.own_size,
                  any_value((2 * n_upto * x - 2 * s_upto - a.own_size * x) / greatest(a.own_size - 1, 1)) as a,
                  min(abs(a.v - m.mean)) as b
           from ahead a left join means m on a.t = m.t and a.c = m.c and a.k = m.k and a.cl <> m.cl group by all),
    score as materialized (
        select t, c, k, round(sum(n * case when own_size = 1 or greatest(a, b) = 0 then 0.0
                                     else (b - a) / greatest(a, b) end) / sum(n), 9) as s
        from ab group by all having count(b) > 0)"""


def silhouette_1d() -> str:
    return (
        f"with recursive {_cluster_ctes()} "
        "select t as table_name, c as column_name, cast(k as integer) as k, round(s, 6) as silhouette from score"
    )


def cluster_report() -> str:
    return f"""with recursive {_cluster_ctes()},
    sized as (select t, c, k, cl, sum(n) as n, min(v) as low, max(v) as high from labelled group by all)
    select t as table_name, c as column_name, cast(k as integer) as clusters_chosen,
           cast(cl as integer) as cluster_id, cast(n as bigint) as cluster_size,
           round(low, 2) as range_low, round(high, 2) as range_high
    from sized join score using (t, c, k) qualify rank() over (partition by t, c order by s desc, k) = 1"""


# ---- sources -------------------------------------------------------------------


def file_manifest() -> str:
    # a header line, and a line for every key
    return """select 'c_mktsegment=' || c_mktsegment as folder, '.csv' as suffix, 1::bigint as files,
        cast(length('c_custkey') + 1 + sum(length(cast(c_custkey as varchar)) + 1) as bigint) as bytes
        from customer group by c_mktsegment"""


def script_listing() -> str:
    listed = f"""select path, octet_length(encode(text)) as length,
        regexp_extract(path, '([^/]*)$', 1) as name, lower(regexp_extract(path, '[.][a-zA-Z]+$')) as suffix
        from ({_filled(views.SCRIPT_FILES)})"""
    rows = """select '{kind}' as kind, path as relative_path,
        case when contains(path, '/') then regexp_extract(path, '^(.*)/', 1) else '(Root Folder)' end as folder,
        regexp_replace(name, '[.][a-zA-Z]+$', '') as stem, length,
        row_number() over (order by path) as place
        from listed where suffix = '.{kind}' and name <> 'n3.py'"""
    return f"""with listed as ({listed}) {rows.format(kind='sql')} and name not like '~$%'
        union all {rows.format(kind='py')}"""


# one row per file: what a loader that skips bad lines or files must find
_LOADED_FILES = """
    customers as (
        select c_custkey, c_mktsegment, c_nationkey as kind, cast(floor(c_custkey / 5000) as int) as b from customer where c_nationkey < 7
    ), cells as (
        select *, concat('n', kind % 3, '/',
                   ['plain', 'plain', 'tabs', 'bars', 'lines', 'bad', 'inch'][kind + 1], '-', b,
                   case kind when 2 then '.tsv' when 3 then '.txt' else '.csv' end) as path,
               case kind when 2 then cast(c_custkey % 97 as varchar) || '.5'
                    when 3 then case when c_custkey % 9 = 0 then null else cast(c_custkey % 89 as varchar) end
                    when 4 then c_mktsegment || chr(10) || 'said "' || (c_custkey % 83) || '"'
                    when 5 then 'a' when 6 then (c_custkey % 7) || '" wide' else c_mktsegment end as value,
               kind = 5 and c_custkey % 11 = 0 as bad
        from customers
    ), loaded as (
        select path, kind, regexp_extract(path, '/(.*)[.]', 1) as stem, count(*) as n, count(*) filter (bad) as n_bad,
               cast(sum(c_custkey) as bigint) as keys, max(value) as top, count(*) filter (value is null) as gaps,
               count(*) filter (not bad) as n_good
        from cells group by path, kind
    )"""


def folder_load() -> str:
    return f"""with {_LOADED_FILES}, numbered as (
        select *, row_number() over (order by path) as table_no, row_number() over (partition by stem order by path) as use
        from loaded where n_bad = 0
    )
    select table_no, stem || case when use > 1 then ' (' || use || ')' else '' end as table_name, path, n as rows, 'loaded' as status,
           case kind when 2 then 'c_custkey bigint,balance double' when 3 then 'c_custkey bigint,balance bigint'
                else 'c_custkey bigint,label string' end as columns, keys, top
    from numbered
    union all
    select null, null, path, null, 'skipped: ' || n_bad || ' lines have more fields than the header', null, null, null
    from loaded where n_bad > 0
    union all select null, null, 'void.csv', null, 'skipped: no lines to read', null, null, null"""


def folder_profile() -> str:
    return f"""with {_LOADED_FILES}, numbered as (
        select *, row_number() over (order by path) as table_no, row_number() over (partition by stem order by path) as use from loaded
    ), columns as (select unnest([1, 2]) as column_no)
    select row_number() over (order by table_no, column_no) as slno, table_no,
           stem || case when use > 1 then ' (' || use || ')' else '' end as table_name, column_no,
           case when column_no = 1 then 'c_custkey' when kind in (2, 3) then 'balance' else 'label' end as column_name,
           case when column_no = 1 or kind = 3 then 'integer' when kind = 2 then 'decimal' else 'text' end as data_type,
           n_good as total_rows, case when column_no = 1 then 0 else gaps end as null_count, 0 as error_count, 0 as blank_count
    from numbered, columns"""


def quoted_records() -> str:
    return f"select p_partkey, label from ({_filled(views.QUOTED_PARTS)})"


def sniffed_files() -> str:
    return """select kind, [',', chr(9), '|', ';', ' '][kind + 1] as separator, false as open_quotes
        from (select distinct cast(c_custkey % 5 as int) as kind from customer)"""


def read_two_encodings() -> str:
    return " union all ".join(
        f"select '{k}' as kind, c_custkey, chr({m}) || c_name as label from customer" for k, m in (("utf8", 233), ("other", 128))
    )


def table_names() -> str:
    return f"""with f as ({_filled(views.FILES)}),
    n as (select *, row_number() over (partition by stem order by path) as i from f)
    select path, case when i = 1 then stem else stem || ' (' || i || ')' end as table_name from n"""


def read_encoded() -> str:
    marks = (("utf8", 233), ("cp1252", 8364), ("latin1", 129))
    return " union all ".join(
        f"select '{k}' as kind, c_custkey, chr({m}) || c_name as label from customer" for k, m in marks
    )


def sniff_delimiter() -> str:
    return (
        "select c_custkey, case c_custkey % 5 when 0 then ',' when 1 then chr(9) when 2 then '|' "
        "when 3 then ';' else ' ' end as separator from customer"
    )


def read_skip_bad() -> str:
    return (
        "select c_custkey, c_name, case when c_custkey % 10 <> 7 then c_mktsegment end as c_mktsegment "
        "from customer where c_custkey % 10 <> 3"
    )


def na_tokens() -> str:
    kept = [(i, t) for i, t in enumerate(views.TOKENS) if t in ("' '", "'-'", "'none'", "'NAN'", "'value'")]
    cases = " ".join(f"when {i} then {t}" for i, t in kept)
    return f"select c_custkey, case c_custkey % {len(views.TOKENS)} {cases} end as token from customer"


def load_report() -> str:
    tables = (
        "region nation customer supplier part orders lineitem events documents embeddings "
        "pages benchmark labels conversations"
    ).split()
    return " union all ".join(
        f"select {i} as table_no, '{t}' as table_name, count(*) as rows, 'loaded' as status from {t}"
        for i, t in enumerate(tables, start=1)
    )


def write_reports() -> str:
    return _union(
        [
            f"select '{t}' as table_name, '{c}' as column_name, count(distinct {c}) as distinct_count from {t}"
            for t, _, c, _ in _each("customer orders", FLAT)
        ]
    )


def text_catalog() -> str:
    return (
        "select lang, cast(sum(1 + length(t) - length(replace(t, chr(10), ''))) as bigint) as lines "
        "from (select lang, regexp_replace(text, '\\r\\n?', chr(10), 'g') as t from documents) group by lang"
    )


def table_preview() -> str:
    parts = []
    for table in "nation customer orders events".split():
        names = list(COLUMNS[table])
        shown, extra = names[:4], names[4:]
        cells = ", ".join(_shown(c, COLUMNS[table][c]) for c in shown)
        note = f"(+{len(extra)} more column(s) not shown: {', '.join(extra)})" if extra else ""
        parts.append(
            f"select '{table}' as table_name, (select count(*) from {table}) as total_rows, "
            f"cast(row_number() over (order by {ORDER[table]}) as integer) as row_no, "
            f"array_to_string([{cells}], ' | ') as cells, '{note}' as not_shown from {table} "
            "qualify row_no <= 10"
        )
    return _union(parts)


# ---- SQL runs ------------------------------------------------------------------


def sql_batches() -> str:
    path = "concat(c_mktsegment, '/', c_name, '.sql')"
    return f"""
    select {path} as path, 1 as batch_no, 'select ' || c_custkey || ' as x' as code from customer where c_custkey % 4 = 0
    union all select {path}, 2, 'select 2 as y' from customer where c_custkey % 4 = 0
    union all select {path}, 3, 'select 3 as z' from customer where c_custkey % 4 = 0
    union all select {path}, 1, 'select ' || c_custkey || ' as x' || chr(10) || 'GO;' from customer
              where c_custkey % 4 = 1"""


def sql_rows() -> str:
    return """
    with seg as (select c_mktsegment, count(*) as n, max(c_acctbal) as top from customer group by 1),
    s as (select *, row_number() over (order by c_mktsegment) as i, count(*) over () as total from seg),
    o as (select *, row_number() over (order by o_orderkey) as i from orders)
    select 'reports/segments.sql' as path, 1 as batch_no, 1 as result_set_no, cast(i as integer) as row_no,
           'c_mktsegment,n,top' as columns, c_mktsegment || ' | ' || n || ' | ' || top as cells,
           total > 4 as truncated from s where i <= 4
    union all select 'reports/segments.sql', 3, 1, cast(i as integer), 'o_orderkey,o_orderstatus',
           o_orderkey || ' | ' || o_orderstatus, true from o where i <= 4
    union all select 'reports/Keys.sql', 2, 1, 1, 'n', cast(count(*) as varchar), false
           from orders where o_totalprice > 100000"""


_RAN = """ran as (
    select case when n_regionkey = 0 then '(Root Folder)' else 'r' || n_regionkey end as folder,
           'n' || n_nationkey || '.sql' as file_name,
           case n_nationkey % 5 when 0 then 'EMPTY' when 1 then 'COMPLETED WITH ERRORS' else 'SUCCESS' end as status,
           cast(n_nationkey % 5 = 1 as bigint) as failed_batches
    from nation)"""


def file_status() -> str:
    return f"""with {_RAN} select case when folder = '(Root Folder)' then file_name else folder || '/' || file_name end as path,
        folder, file_name, status, failed_batches from ran"""


def run_summary() -> str:
    return f"""with {_RAN} select count(*) as total_files, count(*) filter (status = 'SUCCESS') as successful,
        count(*) filter (status like '%ERRORS') as failed_or_errors, count(*) filter (status = 'EMPTY') as empty_files from ran"""


def folder_breaks() -> str:
    return f"""with f as ({_filled(views.FILES)}),
    p as (select path, case when contains(path, '/') then split_part(path, '/', 1) else '(Root Folder)' end as folder,
                 string_split(path, '/')[-1] as file_name from f)
    select path, folder, file_name,
           coalesce(lag(folder) over (order by lower(folder), lower(file_name), path) <> folder, true) as new_folder
    from p"""


def format_cells() -> str:
    cells = ", ".join(
        f"coalesce(cast({c} as varchar), 'NULL') as {c}" for c in COLUMNS["dirty_customer"]
    )
    return f"with {WITH_VIEWS} select {cells} from dirty_customer"


# ---- narration -----------------------------------------------------------------


def narrate_rows() -> str:
    names = list(COLUMNS["dirty_customer"])
    cells = " || '; ' || ".join(
        f"'{c} is ' || case when trim(coalesce(cast({c} as varchar), '')) = '' then 'blank' "
        f"else trim(cast({c} as varchar)) end"
        for c in names
    )
    return f"""with {WITH_VIEWS}
    select 0::bigint as row_no, 'Table with {len(names)} columns and ' || count(*)
           || ' data rows. The columns are: {', '.join(names)}.' as text from dirty_customer
    union all
    select i, 'Row ' || i || ': ' || {cells} || '.'
    from (select *, row_number() over (order by c_custkey) as i from dirty_customer)"""


def assemble_document() -> str:
    text = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
    return f"""with b as ({_filled(views.BLOCKS)}), s as (select doc_id, seq, style, {text} as x from b)
    select doc_id, string_agg(case style when 'heading' then 'Heading: ' || x || '.'
             when 'list' then 'Bullet point: ' || x || '.' else x end, chr(10) || chr(10) order by seq) as text
    from s where x <> '' group by doc_id"""


# words of 0..999 as list wl, so that wl[n + 1] is the word of n
WORDS = """small as (select ['zero','one','two','three','four','five','six','seven','eight','nine','ten',
    'eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen'] as u,
    ['twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety'] as d),
    under100 as (select i, case when i < 20 then u[i + 1] when i % 10 = 0 then d[i // 10 - 1]
                       else d[i // 10 - 1] || '-' || u[i % 10 + 1] end as w
                 from small, range(100) r(i)),
    under1000 as (select h * 100 + i as i, case when h = 0 then w when i = 0 then u[h + 1] || ' hundred'
                       else u[h + 1] || ' hundred and ' || w end as w
                  from under100, small, range(10) r(h)),
    wl as (select list(w order by i) as wl from under1000)"""


def _words(n: str) -> str:
    """Words of a whole number below 10^15."""
    head = (
        f"array_to_string(list_filter(["
        f"case when {n} // 1000000000000 > 0 then wl[{n} // 1000000000000 + 1] || ' trillion' end, "
        f"case when {n} // 1000000000 % 1000 > 0 then wl[{n} // 1000000000 % 1000 + 1] || ' billion' end, "
        f"case when {n} // 1000000 % 1000 > 0 then wl[{n} // 1000000 % 1000 + 1] || ' million' end, "
        f"case when {n} // 1000 % 1000 > 0 then wl[{n} // 1000 % 1000 + 1] || ' thousand' end], "
        "lambda x: x is not null), ', ')"
    )
    rest = f"wl[{n} % 1000 + 1]"
    return (
        f"case when {n} < 1000 then {rest} when {n} % 1000 = 0 then {head} "
        f"when {n} % 1000 < 100 then {head} || ' and ' || {rest} else {head} || ', ' || {rest} end"
    )


def int_to_words() -> str:
    return f"""with {WORDS}, x as (select o_orderkey, o_orderkey * 7654321 - 1000000 as number,
                                        abs(o_orderkey * 7654321 - 1000000) as n from orders)
    select o_orderkey, number, case when number < 0 then 'minus ' else '' end || {_words('n')} as words from x, wl"""


def _amount(spoken_amount: bool, spoken_percent: bool, spoken_name: bool) -> str:
    amount = (
        f"{_words('d')} || case when d = 1 then ' dollar' else ' dollars' end || case when ct = 0 then '' "
        "else ' and ' || wl[ct + 1] || case when ct = 1 then ' cent' else ' cents' end end"
        if spoken_amount
        else "'$' || d || '.' || lpad(cast(ct as varchar), 2, '0')"
    )
    percent = "wl[p + 1] || ' point five percent'" if spoken_percent else "p || '.5%'"
    name = f"'Customer#' || {_words('c_custkey')}" if spoken_name else "c_name"
    return f"""with {WORDS}, x as (select c_custkey, c_name, cast(floor(abs(c_acctbal)) as bigint) as d,
                   c_custkey % 100 as ct, c_custkey % 40 as p from customer)
    select c_custkey, 'Customer ' || {name} || ' holds ' || {amount} || ' and grew ' || {percent}
           || ' this year' as text from x, wl"""


def speak_currency() -> str:
    return _amount(True, False, False)


def speak_percent() -> str:
    return _amount(False, True, False)


def normalize_text() -> str:
    return _amount(True, True, True)


def speak_numbers() -> str:
    return f"""with {WORDS}, x as (select o_orderkey, cast(o_totalprice as varchar) as p from orders),
    y as (select o_orderkey, cast(split_part(p, '.', 1) as bigint) as w, split_part(p, '.', 2) as f from x)
    select o_orderkey, 'Order ' || {_words('o_orderkey')} || ' total ' || {_words('w')} || ' point '
           || array_to_string(list_transform(regexp_extract_all(f, '.'),
                              lambda q: wl[cast(q as integer) + 1]), ' ') as text from y, wl"""


def oracle_sql() -> dict[str, str]:
    made = [
        file_manifest,
        script_listing,
        folder_load,
        folder_profile,
        quoted_records,
        sniffed_files,
        read_two_encodings,
        table_names,
        read_encoded,
        sniff_delimiter,
        read_skip_bad,
        na_tokens,
        load_report,
        write_reports,
        text_catalog,
        table_preview,
        data_dictionary,
        dtype_labels,
        cardinality,
        duplicate_rows,
        key_candidates,
        numeric_summary,
        column_mode,
        decimal_modes,
        quartiles,
        outlier_report,
        outlier_rows,
        outlier_examples,
        first_rows,
        describe_table,
        describe_failing,
        correlation_report,
        correlation_wide,
        value_sample,
        value_patterns,
        column_pairs,
        value_overlap,
        jaccard,
        column_similarity,
        name_similarity,
        silhouette_1d,
        cluster_report,
        sql_batches,
        sql_rows,
        file_status,
        run_summary,
        folder_breaks,
        format_cells,
        narrate_rows,
        assemble_document,
        int_to_words,
        speak_currency,
        speak_percent,
        speak_numbers,
        normalize_text,
    ]
    return {f.__name__: f() for f in made}
