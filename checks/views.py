"""Derived views with the faults that the given tables lack; the same text runs in Spark and DuckDB."""

DIRTY_CUSTOMER = """
select c_custkey,
       case when c_custkey % 11 = 0 then null
            when c_custkey % 13 = 0 then '   '
            when c_custkey % 17 = 0 then '' else c_name end as name,
       case when c_custkey % 19 = 0 then 'n.a.' else cast(c_custkey as string) end as code_text,
       case when c_custkey % 23 = 0 then 'unknown'
            else concat('20', lpad(cast(c_custkey % 24 as string), 2, '0'), '-01-15') end as date_text,
       case when c_custkey % 7 = 0 then null else c_acctbal end as acctbal,
       cast(1 as double) as constant_value,
       case when c_custkey % 50 = 0 then c_acctbal else cast(5 as double) end as spiky,
       cast(null as string) as all_null,
       concat('AB-', lpad(cast(c_custkey as string), 4, '0')) as code_shape
from {customer}
"""

DUP_NATION = """
select * from {nation} union all select * from {nation} where n_regionkey = 1
union all select cast(null as int), null, cast(null as int)
union all select cast(null as int), null, cast(null as int)
"""

# one script per customer: separators with count and comment, a separator that is
# none, nothing but separators, nothing but blanks
SCRIPTS = """
select concat(c_mktsegment, '/', c_name, '.sql') as path,
       case c_custkey % 4
         when 0 then concat('select ', cast(c_custkey as string), ' as x', chr(10), 'GO', chr(10),
                            'select 2 as y', chr(10), ' go 3 -- again', chr(10), 'select 3 as z')
         when 1 then concat('select ', cast(c_custkey as string), ' as x', chr(10), 'GO;', chr(10))
         when 2 then concat('GO', chr(10), '  ', chr(10), 'go', chr(10))
         else '   ' end as text
from {customer}
"""

AMOUNTS = """
select c_custkey,
       concat('Customer ', c_name, ' holds $', cast(cast(floor(abs(c_acctbal)) as bigint) as string),
              '.', lpad(cast(c_custkey % 100 as string), 2, '0'), ' and grew ',
              cast(c_custkey % 40 as string), '.5% this year') as text
from {customer}
"""

TOTALS = """
select o_orderkey,
       concat('Order ', cast(o_orderkey as string), ', total ', cast(o_totalprice as string)) as text
from {orders}
"""

BLOCKS = """
select conv_id as doc_id, turn as seq,
       case role when 'system' then 'heading' when 'user' then 'list' else 'body' end as style, text
from {conversations}
"""

# folders that differ in case only, files at the top level
FILES = """
select case p_partkey % 7
         when 0 then concat(p_name, '-', cast(p_partkey as string), '.sql')
         when 1 then concat(lower(p_brand), '/', p_name, '-', cast(p_partkey as string), '.sql')
         else concat(p_brand, '/', p_name, '-', cast(p_partkey as string), '.sql') end as path,
       p_name as stem
from {part}
"""

TOKENS = (
    "'', 'NA', 'N/A', 'NULL', 'null', 'None', 'NaN', 'nan', 'n/a', '#N/A', '<NA>', "
    "'-nan', '-NaN', '#NA', ' ', '-', 'none', 'NAN', 'value'"
).split(", ")

TOKEN_TEXTS = (
    f"select c_custkey, case c_custkey % {len(TOKENS)} "
    + " ".join(f"when {i} then {t}" for i, t in enumerate(TOKENS))
    + " end as token from {customer}"
)

# statements per file; the tables are read from the given folder
SQL_FILES = {
    "reports/segments.sql": (
        "select c_mktsegment, count(*) as n, max(c_acctbal) as top from customer "
        "group by c_mktsegment order by c_mktsegment;\n"
        "GO\n"
        "select no_such_column from customer\n"
        "go 2 -- kept once\n"
        "select o_orderkey, o_orderstatus from orders order by o_orderkey\n"
    ),
    "reports/Keys.sql": (
        "create or replace temp view big_orders as select * from orders where o_totalprice > 100000\n"
        "GO\n"
        "select count(*) as n from big_orders\n"
    ),
    "lonely.sql": "select count(*) as n from big_orders\n",
    "blank.sql": "GO\n  \n",
}

# one script per nation: a fifth is blank, a fifth has a batch that fails
NATION_SCRIPTS = """
select case when n_regionkey = 0 then concat('n', n_nationkey, '.sql')
            else concat('r', n_regionkey, '/n', n_nationkey, '.sql') end as path,
       case n_nationkey % 5
            when 0 then concat('GO', chr(10), '  ')
            when 1 then concat('select count(*) as n from customer where c_nationkey = ', n_nationkey,
                               '; -- one; two', chr(10), 'select c_name, "a;b" as x from customer', chr(10), 'GO', chr(10),
                               'select no_such_column from customer', chr(10), 'go', chr(10), 'select 1 as last')
            else concat('select count(*) as n from customer where c_nationkey = ', n_nationkey) end as text
from {nation}
"""

# a script per nation: empty ones, hidden names, lock files, two kinds
SCRIPT_FILES = """
select concat(case when n_regionkey = 0 then '' else concat('r', n_regionkey, '/') end,
              case n_nationkey % 6 when 1 then '_' when 2 then '~$' when 4 then '.' else '' end,
              'n', n_nationkey, case n_nationkey % 4 when 3 then '.py' when 2 then '.SQL' else '.sql' end) as path,
       case when n_nationkey % 5 = 0 then '' else concat('select ', n_nationkey, chr(10)) end as text
from {nation}
"""

# the customers of a few nations as files, 5,000 keys each at most: separators, headers, quotes, bad lines, nothing
CUSTOMER_FILES = """
select concat('n', c_nationkey % 3, '/', case c_nationkey when 0 then 'plain' when 1 then 'plain'
              when 2 then 'tabs' when 3 then 'bars' when 4 then 'lines' when 5 then 'bad' else 'inch' end, '-',
              cast(floor(c_custkey / 5000) as int),
              case c_nationkey when 2 then '.tsv' when 3 then '.txt' else '.csv' end) as path,
       concat(case c_nationkey when 2 then concat('c_custkey', chr(9), 'balance') when 3 then 'c_custkey|balance'
              else 'c_custkey,label' end, chr(10),
              array_join(array_sort(array_agg(
                case c_nationkey
                  when 2 then concat(lpad(cast(c_custkey as string), 12, ' '), chr(9), cast(c_custkey % 97 as string), '.5')
                  when 3 then concat(lpad(cast(c_custkey as string), 12, ' '), '|', case when c_custkey % 9 = 0 then 'NA' else cast(c_custkey % 89 as string) end)
                  when 4 then concat(lpad(cast(c_custkey as string), 12, ' '), ',"', c_mktsegment, chr(10), 'said ""', cast(c_custkey % 83 as string), '""', '"')
                  when 5 then concat(lpad(cast(c_custkey as string), 12, ' '), ',a', case when c_custkey % 11 = 0 then ',b' else '' end)
                  when 6 then concat(lpad(cast(c_custkey as string), 12, ' '), ',', cast(c_custkey % 7 as string), '" wide')
                  else concat(lpad(cast(c_custkey as string), 12, ' '), ',', c_mktsegment) end)), chr(10)), chr(10)) as text
from {customer} where c_nationkey < 7 group by c_nationkey, cast(floor(c_custkey / 5000) as int)
union all select 'void.csv', ''
"""

QUOTED_PARTS = """
select p_partkey, case p_partkey % 5
         when 0 then concat(p_name, ' 5" wide')
         when 1 then concat('"', p_name, '"')
         when 2 then concat(p_name, chr(10), '"', p_type, '", ', p_brand)
         when 3 then concat(p_name, ',', chr(10), chr(10), 'x')
         else p_name end as label
from {part}
"""

# decimals of several scales, with ties across lengths and signs
PRICED = """
select cast(p_partkey - 9 as decimal(12, 2)) as ids, cast((p_partkey % 24 - 12) * 0.5 as decimal(10, 1)) as halves,
       cast(p_retailprice as decimal(38, 6)) as price, cast(p_size as decimal(5, 0)) as size
from {part}
"""

# a view with two columns that fail on some rows
FAILING = """
select o_orderkey, if(o_totalprice > 1000, int(raise_error('price')), 0) as band, o_totalprice,
       if(o_orderstatus = 'F', raise_error('status'), o_orderstatus) as open_status, o_orderstatus
from {orders}
"""

# more numeric columns than one generated aggregate takes pairs of, with gaps in different rows
WIDE = (
    "select l_quantity, l_extendedprice, l_discount, l_tax, "
    + ", ".join(
        f"case when (l_orderkey + l_linenumber) % {i + 2} = 0 then null "
        f"else l_extendedprice * {i} - l_quantity * 900.0 * (l_partkey % {i + 3}) end as w{i}"
        for i in range(1, 11)
    )
    + " from {lineitem}"
)
