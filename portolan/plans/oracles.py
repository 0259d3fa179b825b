"""The same rows in SQL, over tables of the same names."""

from __future__ import annotations

from portolan.plans.expected_report import REPORT, SHEETS
from portolan.plans.rendered import IO_OPERATIONS, TEMPLATES, TEXT_PATTERNS


# ---- what is expected, stated here apart from the code that is compared with it; fixed values

ROLES = ("productor_numerico", "productor_passfail", "consumidor_medicion", "consumidor_resultado", "consumidor_general", "mixto", "indeterminado")
FACTOR_WEIGHTS = {"riesgo": 2.0, "dependencias": 1.5, "reutilizacion_potencial": 0.5, "reglas_negocio": 0.5, "complejidad_tecnica": -0.5, "complejidad_integracion": -0.5}
#: Statement words, and what stands before the first table of a statement.
KEYWORDS = r"(?i)\b(select|insert\s+into|update|delete\s+from|with|create|alter|drop|exec(ute)?)\b"
TABLE_PATTERNS = (r"(?i)\bupdate\s+\[?([\w\.]+)\]?", r"(?i)\bfrom\s+\[?([\w\.]+)\]?", r"(?i)\binto\s+\[?([\w\.]+)\]?")
#: The label of each of the rendered operations, in their order.
IO_GROUPS = ("Archivos", "Red / HTTP", "Impresion", "Puerto serial", "Proceso externo", "Correo (SMTP)", "Otro", "Archivos", "Otro")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(column: str, values) -> str:
    return f"upper(trim({column})) IN ({', '.join(_q(v) for v in values)})"


def _case(column: str, values, zero: int = 0) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k + zero} THEN {_q(v)}" for k, v in enumerate(values)) + " END"


#: What each of the templates does and names, as read by hand.
READ = {
    0: ("insert", "IL ReflA Serial_Number"), 1: ("update", "STATUS DEVICE"), 2: ("insert", "STATUS WAVE"), 3: ("select", "ILEndA ILEndB"), 4: ("select", "TEST_DATE STATUS"), 5: ("select", "STATUS DEVICE"),
    6: ("select", "Customer Qty"), 7: ("delete", ""), 8: ("insert", ""), 9: ("select", ""), 10: ("update", "ILPassLimit RLPassLimit"), 11: ("merge", ""), 13: ("select", "Serial Wave"),
}


FLOW = f"""
WITH k AS (
  SELECT l_orderkey AS app_id, l_linenumber AS seq, l_partkey,
         CASE WHEN (l_suppkey + l_linenumber * 3) % {len(TEMPLATES)} IN (0, 3, 4) AND l_partkey % 4 = 0 THEN 6 ELSE (l_suppkey + l_linenumber * 3) % {len(TEMPLATES)} END AS k
  FROM lineitem),
t AS (SELECT *, {_case("seq % 3", ("dbo.Part_", "part_", "Part_"))} || l_partkey AS target FROM k),
f AS (
  SELECT app_id, seq, target, k, k = 12 AS is_sp, replace({_case("k", TEMPLATES)}, '{{t}}', target) AS raw,
         CASE WHEN k = 9 AND seq % 2 = 0 THEN ['STATUS', 'TEST_DATE'] END AS results
  FROM t),
o AS (
  SELECT *, CASE k {" ".join(f"WHEN {k} THEN {_q(op)}" for k, (op, _) in READ.items())} END AS op,
         nullif(regexp_replace(upper(trim(target)), '^DBO\\.', ''), '') AS key
  FROM f),
c AS (SELECT *, coalesce(results, string_split(CASE k {" ".join(f"WHEN {k} THEN {_q(names)}" for k, (_, names) in READ.items() if names)} END, ' ')) AS found FROM o),
ops AS (SELECT *, CASE WHEN len(found) > 0 THEN found ELSE [] END AS cols FROM c),
flat AS (SELECT app_id, target, key, op, is_sp, unnest(CASE WHEN len(cols) > 0 THEN cols ELSE [NULL] END) AS col FROM ops),
marks AS (
  SELECT *, coalesce({_in("col", ("IL", "REFLA", "REFLB", "ILENDA", "ILENDB"))}, false) AS m, coalesce({_in("col", ("STATUS", "DEVICE", "CONNECTOR", "ENDS", "SERIAL_NUMBER", "EMPLOYEE_NUMBER", "WIP_ENTITY_NAME"))}, false) AS a,
         coalesce({_in("col", ("TEST_DATE", "DEVICE_STATUS", "PASSFAIL", "IL", "REFLA", "REFLB", "ILENDA", "ILENDB"))} OR regexp_matches(col, '(?i)^TEST_[A-Z0-9_]+_ID$'), false) AS st
  FROM flat),
ctx AS (SELECT key, bool_or(st) AS confirmed FROM marks WHERE NOT is_sp AND op IS NOT NULL GROUP BY key),
g AS (
  SELECT app_id, target, key, bool_or(op <> 'select') AS w, bool_or(op = 'select') AS r,
         bool_or(op <> 'select' AND m) AS wm, bool_or(op <> 'select' AND (col IS NOT NULL OR op = 'delete')) AS wk,
         bool_or(op = 'select' AND m) AS rm, bool_or(op = 'select' AND st) AS rs, bool_or(op = 'select' AND a) AS ra, bool_or(op = 'select' AND col IS NOT NULL) AS rk
  FROM marks WHERE op IS NOT NULL GROUP BY ALL),
roles AS (
  SELECT app_id, target, g.key, CASE
    WHEN w AND r THEN 'mixto' WHEN w AND wm THEN 'productor_numerico' WHEN w AND wk THEN 'productor_passfail' WHEN w THEN 'indeterminado'
    WHEN rm THEN 'consumidor_medicion' WHEN rs OR (ra AND coalesce(confirmed, false)) THEN 'consumidor_resultado' WHEN rk THEN 'consumidor_general' ELSE 'indeterminado' END AS role
  FROM g LEFT JOIN ctx USING (key)),
sides AS (
  SELECT key, app_id, bool_or(role IN ('productor_numerico', 'productor_passfail', 'mixto')) AS p, bool_or(role LIKE 'consumidor%' OR role = 'mixto') AS c
  FROM roles WHERE role <> 'indeterminado' GROUP BY ALL)
"""

#: Roles per application and key: the marks of all spellings of a table together.
KEYED = (
    FLOW
    + """,
kg AS (
  SELECT app_id, key, bool_or(op <> 'select') AS w, bool_or(op = 'select') AS r,
         bool_or(op <> 'select' AND m) AS wm, bool_or(op <> 'select' AND (col IS NOT NULL OR op = 'delete')) AS wk,
         bool_or(op = 'select' AND m) AS rm, bool_or(op = 'select' AND st) AS rs, bool_or(op = 'select' AND a) AS ra, bool_or(op = 'select' AND col IS NOT NULL) AS rk
  FROM marks WHERE op IS NOT NULL GROUP BY ALL),
kn AS (SELECT app_id, key, count(*) FILTER (op = 'select') AS n_reads, count(*) FILTER (op <> 'select') AS n_writes FROM ops WHERE op IS NOT NULL GROUP BY ALL),
keyed AS (
  SELECT app_id, key, n_reads, n_writes, CASE
    WHEN w AND r THEN 'mixto' WHEN w AND wm THEN 'productor_numerico' WHEN w AND wk THEN 'productor_passfail' WHEN w THEN 'indeterminado'
    WHEN rm THEN 'consumidor_medicion' WHEN rs OR (ra AND coalesce(confirmed, false)) THEN 'consumidor_resultado' WHEN rk THEN 'consumidor_general' ELSE 'indeterminado' END AS role
  FROM kg JOIN kn USING (app_id, key) LEFT JOIN ctx USING (key))
"""
)

_STATUS = "CASE role WHEN 'indeterminado' THEN 'unresolved_no_columns' ELSE 'resolved' END AS status"

SETTINGS = """
s AS (
  SELECT c_custkey AS app_id, c_name AS app_name, 'Conn' || (c_custkey % 3) AS name, c_custkey % 8 IN (0, 4) AS marked,
         CASE c_custkey % 8
           WHEN 0 THEN 'Data Source=' || srv || ';Initial Catalog=Db;User Id=u;Password=pw' || c_custkey
           WHEN 1 THEN 'server = ' || lower(srv) || ';database=Db;pwd= ;uid=x'
           WHEN 2 THEN 'C:\\Data\\in' WHEN 3 THEN '\\\\share\\out' WHEN 4 THEN 'dfgsdf'
           WHEN 5 THEN 'Server=old;Server=' || srv ELSE c_mktsegment END AS value
  FROM (SELECT *, 'SRV' || c_nationkey || '-' || (c_custkey % 101) AS srv FROM customer)),
cat AS (
  SELECT *, CASE WHEN marked OR regexp_matches(value, '(?i)(Server|Data Source|Database|User Id|UID)\\s*=') THEN 'sql_or_oracle' WHEN regexp_matches(value, '^([A-Za-z]:\\\\|\\\\\\\\|/)') THEN 'local_path' ELSE 'other' END AS category,
         lower(nullif(trim(regexp_extract_all(value, '(?i)(?:^|;)\\s*(?:server|data\\s+source)\\s*=\\s*([^;]*)', 1)[-1]), '')) AS server,
         nullif(trim(regexp_extract_all(value, '(?i)(?:^|;)\\s*(?:database|initial\\s+catalog)\\s*=\\s*([^;]*)', 1)[-1]), '') AS database
  FROM s)
"""

SUPPLIER_FINDINGS = f"""
{SETTINGS.strip()},
sf AS (SELECT l_suppkey AS app_id, 'T_' || l_partkey || '_' || l_linenumber AS target, {_case("l_linenumber % 5", ("oracle_package_call", "stored_procedure", "query", "query", "query"))} AS category FROM lineitem),
st AS (
  SELECT *, CASE WHEN app_id % 7 = 0 THEN CASE WHEN table_name = 'P_3' THEN NULL ELSE '["A"]' END WHEN table_name IN ('P_1', 'P_2') THEN '["B"]' ELSE '["A"]' END AS columns_json
  FROM (SELECT DISTINCT l_suppkey AS app_id, l_returnflag AS schema_name, 'P_' || (l_partkey % 50) AS table_name FROM lineitem)),
apps AS (
  SELECT s_suppkey AS app_id, s_name AS app_name, CASE WHEN s_suppkey % 5 = 0 THEN 'borrador' ELSE 'logica_revisada' END AS review_status,
         CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE (SELECT count(*) FROM range(0, s_suppkey % 9 + 1) r(i) WHERE i % 3 <> 2) END AS n_rules
  FROM supplier),
cur AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'Gone#' ELSE 'Supplier#' END || lpad(CAST(o_custkey % 100 AS VARCHAR), 9, '0') AS app_name,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'critica' WHEN '2-HIGH' THEN 'alta' WHEN '3-MEDIUM' THEN 'media' WHEN '5-LOW' THEN 'info' ELSE 'rara' END AS severity
  FROM orders),
flags AS (SELECT l_suppkey AS app_id, {_case("l_linenumber % 3", ("alta", "media", "info"))} AS severity FROM lineitem WHERE l_returnflag = 'R'),
io AS (SELECT user_id AS app_id, event_id AS id, {_case(f"event_id % {len(IO_OPERATIONS)}", IO_OPERATIONS)} AS operation FROM events),
sides AS (SELECT target, app_id, bool_or(category IN ('query', 'stored_procedure')) AS q FROM sf GROUP BY ALL),
edges AS (SELECT a.app_id AS app_a, b.app_id AS app_b, a.target AS resource FROM sides a JOIN sides b ON a.target = b.target AND b.app_id > a.app_id WHERE a.q),
servers AS (SELECT a.app_id AS app_a, b.app_id AS app_b FROM (SELECT apps.*, server FROM cat JOIN apps USING (app_id) WHERE category = 'sql_or_oracle') a JOIN (SELECT apps.*, server FROM cat JOIN apps USING (app_id) WHERE category = 'sql_or_oracle') b ON a.server = b.server AND a.app_name < b.app_name),
members AS (SELECT DISTINCT app_name, schema_name || table_name AS category FROM st JOIN apps USING (app_id) WHERE table_name <> 'P_9'),
w AS (SELECT * FROM (VALUES ('critica', 3), ('alta', 2), ('media', 1)) v(severity, weight)),
raw AS (
  SELECT app_id, 'complejidad_tecnica' AS factor, CAST((SELECT count(DISTINCT target) FROM sf WHERE sf.app_id = apps.app_id) + (SELECT count(DISTINCT (schema_name, table_name)) FROM st WHERE st.app_id = apps.app_id) AS DOUBLE) AS raw FROM apps
  UNION ALL SELECT app_id, 'riesgo', CAST(coalesce((SELECT sum(weight) FROM cur JOIN w USING (severity) WHERE cur.app_name = apps.app_name), 0) + coalesce((SELECT sum(weight) FROM flags JOIN w USING (severity) WHERE flags.app_id = apps.app_id), 0) AS DOUBLE) FROM apps
  UNION ALL SELECT app_id, 'dependencias', CAST(coalesce(n, 0) AS DOUBLE) FROM apps LEFT JOIN (SELECT app_id, count(*) AS n FROM (SELECT app_a AS app_id FROM edges UNION ALL SELECT app_b FROM edges UNION ALL SELECT app_a FROM servers UNION ALL SELECT app_b FROM servers) GROUP BY 1) USING (app_id)
  UNION ALL SELECT app_id, 'reglas_negocio', CAST(CASE WHEN review_status <> 'borrador' THEN n_rules END AS DOUBLE) FROM apps
  UNION ALL SELECT app_id, 'complejidad_integracion', CAST((SELECT count(*) FROM io WHERE io.app_id = apps.app_id) AS DOUBLE) FROM apps
  UNION ALL SELECT app_id, 'reutilizacion_potencial', CAST(coalesce((SELECT sum(n - 1) FROM members JOIN (SELECT category, count(*) AS n FROM members GROUP BY 1) USING (category) WHERE members.app_name = apps.app_name), 0) AS DOUBLE) FROM apps),
limits AS (SELECT factor, list_sort(list(raw)) AS v FROM raw WHERE raw IS NOT NULL GROUP BY factor),
buckets AS (
  SELECT app_id, factor, raw, CASE WHEN raw IS NULL THEN NULL WHEN v[-1] = 0 OR raw <= v[len(v) // 3 + 1] THEN 'Baja' WHEN raw <= v[len(v) * 2 // 3 + 1] THEN 'Media' ELSE 'Alta' END AS bucket
  FROM raw LEFT JOIN limits USING (factor)),
contrib AS (
  SELECT *, CASE factor {" ".join(f"WHEN {_q(n)} THEN {x}" for n, x in FACTOR_WEIGHTS.items())} END * CAST(CASE bucket WHEN 'Baja' THEN 0 WHEN 'Media' THEN 1 WHEN 'Alta' THEN 2 END AS DOUBLE) AS contribution
  FROM buckets),
scores AS (SELECT app_id, CAST(round(coalesce(sum(contribution), 0), 2) AS DOUBLE) AS score, count(bucket) AS n_factors FROM contrib GROUP BY 1)
"""


def _portfolio(select: str) -> str:
    return f"WITH {SUPPLIER_FINDINGS} {select}"


def _factor(name: str) -> str:
    return _portfolio(f"SELECT app_id, factor, raw FROM raw WHERE factor = '{name}'")


_FOOTPRINT = f"""
WITH {SETTINGS}, both_ AS (SELECT app_id, name, server FROM cat WHERE category = 'sql_or_oracle' UNION ALL SELECT app_id, name, 'other' FROM cat WHERE category = 'sql_or_oracle' AND app_id % 16 = 0),
n AS (SELECT app_id, name, count(DISTINCT server) AS n, min(server) AS server FROM both_ WHERE server IS NOT NULL GROUP BY ALL),
j AS (SELECT f.app_id, target, n, server FROM (SELECT DISTINCT o_custkey AS app_id, 'T' || (o_orderkey % 10) AS target, 'Conn' || (o_custkey % 3) AS name FROM orders) f LEFT JOIN n USING (app_id, name))
"""

#: Where the classes and methods of the rendered files begin and end: of screens with and without an overload, of programs and of repositories.
_CONTAINMENT = """
WITH spans(kind, what, a, b, name) AS (VALUES
    ('even', 'c', 6, 77, 'Form'), ('even', 'm', 11, 22, 'Load'), ('even', 'm', 24, 30, 'Save'), ('even', 'm', 32, 38, 'Branch'), ('even', 'm', 40, 49, 'Build'), ('even', 'm', 51, 53, 'Helper'),
    ('even', 'm', 55, 57, 'Helper'), ('even', 'm', 59, 67, 'InitializeComponent'), ('even', 'm', 69, 76, 'btnSave_Click'),
    ('odd', 'c', 6, 73, 'Form'), ('odd', 'm', 11, 22, 'Load'), ('odd', 'm', 24, 30, 'Save'), ('odd', 'm', 32, 38, 'Branch'), ('odd', 'm', 40, 49, 'Build'), ('odd', 'm', 51, 53, 'Helper'),
    ('odd', 'm', 55, 63, 'InitializeComponent'), ('odd', 'm', 65, 72, 'btnSave_Click'), ('program', 'c', 3, 8, 'Program'), ('program', 'm', 4, 7, 'Main'),
    ('store', 'c', 5, 92, 'Store'), ('store', 'm', 9, 17, 'Direct'), ('store', 'm', 19, 30, 'Passed'), ('store', 'm', 32, 36, 'Choice'), ('store', 'm', 38, 53, 'Branches'), ('store', 'm', 55, 69, 'Guarded'),
    ('store', 'm', 71, 74, 'Shared'), ('store', 'm', 76, 80, 'Written'), ('store', 'm', 82, 86, 'Built'), ('store', 'm', 88, 91, 'Ledger')),
files AS (
    SELECT p_brand AS app_name, 'Screens/Form' || p_partkey || '.cs' AS file, CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, CASE WHEN p_partkey % 2 = 0 THEN 78 ELSE 74 END AS size, p_partkey AS p FROM part
    UNION ALL SELECT p_brand, 'Program' || p_partkey || '.cs', 'program', 9, p_partkey FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT 'App' || p_partkey, 'Data/Store.cs', 'store', 93, p_partkey FROM part),
lines AS (SELECT *, unnest(range(1, size + 1)) AS n FROM files)
SELECT app_name, file, n, CASE WHEN c.name = 'Form' THEN c.name || p ELSE c.name || CASE WHEN c.name = 'Store' THEN p::VARCHAR ELSE '' END END AS class_name, m.name AS method
FROM lines l LEFT JOIN spans c ON c.kind = l.kind AND c.what = 'c' AND n BETWEEN c.a AND c.b LEFT JOIN spans m ON m.kind = l.kind AND m.what = 'm' AND n BETWEEN m.a AND m.b
"""

#: What is left when each order's first statement has gone.
_WITHOUT_FIRST = FLOW.replace("FROM lineitem)", "FROM lineitem WHERE l_linenumber <> 1)", 1)

#: The table of each strong relation, with what either side does.
_EVIDENCE = (
    FLOW
    + """,
ev AS (
  SELECT app_id, key, min(target) AS spelled, array_to_string(list_sort(list(DISTINCT s) FILTER (op <> 'select')), ' ') AS w, array_to_string(list_sort(list(DISTINCT s) FILTER (op = 'select')), ' ') AS r
  FROM (SELECT *, op || '(' || array_to_string(cols, ',') || ')' AS s FROM ops WHERE op IS NOT NULL AND key IS NOT NULL) GROUP BY ALL),
rel AS (
  SELECT a.app_id AS producer, b.app_id AS consumer, a.key AS table_key, x.spelled AS written, y.spelled AS read, x.w AS write_ops, y.r AS read_ops
  FROM sides a JOIN sides b ON a.key = b.key AND a.app_id <> b.app_id JOIN ev x ON x.app_id = a.app_id AND x.key = a.key JOIN ev y ON y.app_id = b.app_id AND y.key = a.key WHERE a.p AND b.c)
"""
)

_NODE = "coalesce(nullif(left(regexp_replace({0}, '[^\\w]', '_', 'g'), 60), ''), 'n')"
#: Each application in the middle: up to 80 nodes, those it feeds first.
_RELATIONS_DIAGRAM = (
    _EVIDENCE
    + f""",
arrows AS (
  SELECT 'App' || app AS app_name, side, 'App' || other AS other, array_to_string(list_sort(list(DISTINCT t)), ', ') AS tables
  FROM (SELECT producer AS app, 1 AS side, consumer AS other, written AS t FROM rel UNION ALL SELECT consumer, 2, producer, read FROM rel) GROUP BY ALL),
items AS (
  SELECT *, 1 + sum(new) OVER (PARTITION BY app_name ORDER BY side, other) - new AS before
  FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY app_name, other ORDER BY side) = 1 THEN 1 ELSE 0 END AS new FROM arrows)),
loops AS (SELECT DISTINCT 'App' || s.app_id AS app_name, spelled FROM sides s JOIN ev ON ev.app_id = s.app_id AND ev.key = s.key WHERE p AND c),
apps AS (SELECT app_name FROM arrows UNION SELECT app_name FROM loops),
lines AS (
  SELECT app_name, 0 AS a, '' AS b, 0 AS c, 'flowchart LR' AS line FROM apps
  UNION ALL SELECT app_name, 1, '', 0, '    app_' || {_NODE.format("app_name")} || '["' || app_name || '"]:::focalNode' FROM apps
  UNION ALL SELECT app_name, 1 + side, other, 0, '    app_' || {_NODE.format("other")} || '("' || other || '")' FROM items WHERE before < 80 AND new = 1
  UNION ALL SELECT app_name, 1 + side, other, 1, CASE side WHEN 1 THEN '    app_' || app_name || ' -->|"' || tables || '"| app_' || other ELSE '    app_' || other || ' -->|"' || tables || '"| app_' || app_name END FROM items WHERE before < 80
  UNION ALL SELECT app_name, 4, spelled, 0, '    app_' || app_name || ' -->|"' || spelled || '"| app_' || app_name FROM loops
  UNION ALL SELECT DISTINCT app_name, 5, '', 0, '    nota_truncado["... relaciones adicionales truncadas — ver las tablas completas abajo"]' FROM items WHERE before >= 80
  UNION ALL SELECT app_name, 6, '', 0, '    classDef focalNode fill:#e1eef8,stroke:#1c6fc9,color:#17324d,font-weight:bold;' FROM apps)
SELECT app_name, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY a, b, c)) AS mermaid_md5 FROM lines GROUP BY 1
"""
)

_CLASSES_DIAGRAM = f""",
resources AS (
  SELECT DISTINCT 'A' || (app_id % 7) AS app_name, 'Class ' || app_id AS class_name, CASE category WHEN 'query' THEN 2 ELSE 1 END AS g, target FROM sf
  UNION SELECT 'A' || (user_id % 7), 'Class ' || user_id, 3, ['Archivos / carpetas', 'Red (HTTP/SMTP)', 'Impresora', 'Puerto serial', 'Proceso externo', 'Red (HTTP/SMTP)', 'Reflection / COM', 'Archivos / carpetas', 'PLC / Modbus'][event_id % 9 + 1] FROM events),
items AS (
  SELECT *, sum(new) OVER (PARTITION BY app_name ORDER BY class_name, g, target) - new AS before
  FROM (SELECT *, CASE WHEN g = 0 OR row_number() OVER (PARTITION BY app_name, g, target ORDER BY class_name) = 1 THEN 1 ELSE 0 END AS new
        FROM (SELECT * FROM resources UNION ALL SELECT DISTINCT app_name, class_name, 0, NULL FROM resources))),
named AS (SELECT *, 'class_' || {_NODE.format("class_name")} AS c, ['sp_', 'table_', 'io_'][g] || {_NODE.format("target")} AS t FROM items WHERE before < 80),
lines AS (
  SELECT DISTINCT app_name, 0 AS part, '' AS class_name, 0 AS g, '' AS target, 0 AS sub, 'flowchart LR' AS line FROM items
  UNION ALL SELECT app_name, 1, class_name, g, target, 0, CASE g WHEN 0 THEN '    ' || c || '["' || class_name || '"]:::classNode' WHEN 1 THEN '    ' || t || '[["' || target || '"]]' WHEN 2 THEN '    ' || t || '[("' || target || '")]' ELSE '    ' || t || '("' || target || '")' END
  FROM named WHERE new = 1
  UNION ALL SELECT app_name, 1, class_name, g, target, 1, '    ' || c || CASE g WHEN 3 THEN ' -.-> ' ELSE ' --> ' END || t FROM named WHERE g > 0
  UNION ALL SELECT DISTINCT app_name, 2, '', 0, '', 0, '    nota_truncado["... diagrama truncado (demasiados elementos) — ver la tabla completa abajo"]' FROM items WHERE before >= 80
  UNION ALL SELECT DISTINCT app_name, 3, '', 0, '', 0, '    classDef classNode fill:#e1eef8,stroke:#1c6fc9,color:#17324d;' FROM items)
SELECT app_name, row_number() OVER (PARTITION BY app_name ORDER BY part, class_name, g, target, sub) AS place, line FROM lines
"""

_REPORT = f"""
WITH e(k, line, there) AS (SELECT * FROM (VALUES {", ".join(f"({k}, {_q(line)}, {_q(there)})" for k, (there, line) in enumerate(REPORT))})),
p AS (SELECT p_partkey AS p, p_type, ['true'] || {" || ".join(f"CASE WHEN {c} THEN [{_q(c)}] ELSE [] END" for c in sorted({c for c, _ in REPORT} - {"true"}))} AS holds FROM part)
SELECT 'App' || p AS app_name, row_number() OVER (PARTITION BY p ORDER BY k) AS place, replace(replace(line, '{{p}}', p::VARCHAR), '{{type}}', p_type) AS line FROM p JOIN e ON list_contains(holds, there)
"""

_SHEETS = f"""
WITH e(k, title, there, cells) AS (SELECT * FROM (VALUES {", ".join(f"({k}, {_q(title)}, {_q(there)}, {_q(chr(9).join(cells))})" for k, (title, there, cells) in enumerate(SHEETS))})),
p AS (SELECT p_partkey AS p, p_type, ['true'] || {" || ".join(f"CASE WHEN {c} THEN [{_q(c)}] ELSE [] END" for c in sorted({c for _, c, _ in SHEETS} - {"true"}))} AS holds FROM part)
SELECT 'App' || p AS app_name, title, row_number() OVER (PARTITION BY p, title ORDER BY k) AS row, replace(replace(cells, '{{p}}', p::VARCHAR), '{{type}}', p_type) AS cells FROM p JOIN e ON list_contains(holds, there)
"""

#: What each method of a part's repository class is expected to show; every fifth part has no configuration file, and so no setting Other.
_CODE_FOOTPRINT = """
WITH m(method, kind, target, connection, server, database, status, file) AS (VALUES
    ('Direct', 'S', 'Direct_', 'Main', 'srv', 'Db', 'resolved', 'Data/Store.cs'), ('Passed', 'S', 'Passed_', 'Main', 'srv', 'Db', 'resolved', 'Data/Store.cs'),
    ('Choice', 'S', 'Choice_', NULL, NULL, NULL, 'unresolved_ambiguous_conditional', 'Data/Store.cs'), ('Branches', 'S', 'Branches_', NULL, NULL, NULL, 'unresolved_ambiguous_conditional', 'Data/Store.cs'),
    ('Guarded', 'S', 'Guarded_', 'Main', 'srv', 'Db', 'resolved', 'Data/Store.cs'), ('Shared', 'S', 'Shared_', NULL, NULL, NULL, 'unresolved_out_of_scope', 'Data/Store.cs'),
    ('Written', 'S', 'Written_', NULL, 'lab', 'Lab', 'resolved', 'Data/Store.cs'), ('Built', 'O', 'Built_', NULL, NULL, NULL, 'unresolved_no_literal', 'Data/Store.cs'),
    ('Ledger', 'O', 'GL_LINES', 'Other', 'other', NULL, 'resolved', 'Data/Store.cs'), ('Direct', 'S', 'Direct_', NULL, NULL, NULL, 'unresolved_no_source_file', 'Data/Gone.cs')),
f AS (
    SELECT 'App' || p_partkey AS app_name, file, 'Store' AS class_name, method, CASE WHEN target = 'GL_LINES' THEN target ELSE target || p_partkey END AS target,
           CASE WHEN connection = 'Main' THEN 'Main' || p_partkey ELSE connection END AS connection, CASE WHEN connection = 'Other' AND p_partkey % 5 = 0 THEN NULL ELSE server || p_partkey END AS server, database,
           CASE WHEN connection = 'Other' AND p_partkey % 5 = 0 THEN 'unresolved_no_literal' ELSE status END AS status, target = 'GL_LINES' AS is_erp
    FROM part, m)
"""

_TABLE = "coalesce(" + ", ".join(f"nullif(regexp_extract(raw, {_q(p)}, 1), '')" for p in TABLE_PATTERNS) + ")"

#: Factors in the report's order, and what their buckets mean.
_DECISION = _portfolio(""", d AS (
  SELECT c.*, place, label FROM contrib c JOIN (VALUES ('complejidad_tecnica', 1::BIGINT, 'Complejidad tecnica'), ('riesgo', 2, 'Riesgo'), ('dependencias', 3, 'Dependencias'), ('reglas_negocio', 4, 'Reglas de negocio'), ('complejidad_integracion', 5, 'Complejidad de integracion'), ('reutilizacion_potencial', 6, 'Reutilizacion potencial')) l(factor, place, label) USING (factor)),
t AS (SELECT * FROM (VALUES
  (1, 'Alta', 'Superficie de datos grande: muchas consultas/SP/tablas que reconstruir.'), (1, 'Media', 'Superficie de datos moderada.'), (1, 'Baja', 'Superficie de datos pequena: poco que reconstruir en la capa de datos.'),
  (2, 'Alta', 'Concentra hallazgos de severidad alta/critica -- revisar antes de comprometer fecha de migracion.'), (2, 'Media', 'Riesgo moderado, sin señales de severidad critica dominante.'), (2, 'Baja', 'Sin hallazgos de riesgo relevantes detectados hasta ahora.'),
  (3, 'Alta', 'Muy interconectada: conviene migrarla junto con las apps que comparten sus recursos, no de forma aislada.'), (3, 'Media', 'Comparte algunos recursos con otras apps -- coordinar el orden de migracion.'), (3, 'Baja', 'Poco o nada interconectada -- puede migrarse de forma independiente.'),
  (4, 'Alta', 'Mucho volumen documentado de logica de negocio -- probable esfuerzo funcional alto.'), (4, 'Media', 'Volumen medio de logica de negocio documentada.'), (4, 'Baja', 'Poco volumen de logica de negocio documentada hasta ahora.'),
  (5, 'Alta', 'Depende de varias integraciones externas -- replicarlas es parte critica del esfuerzo.'), (5, 'Media', 'Algunas integraciones externas a replicar.'), (5, 'Baja', 'Pocas o ninguna integracion externa detectada.'),
  (6, 'Alta', 'Comparte varios patrones con otras apps -- una solucion aqui es reutilizable en el resto del portafolio.'), (6, 'Media', 'Comparte algunos patrones con otras apps.'), (6, 'Baja', 'Poco o nada de conocimiento reutilizable detectado con otras apps todavia.')) v(place, bucket, text))
""")

ORACLES: dict[str, str] = {
    "flow_operation": FLOW + "SELECT coalesce(op, 'none') AS op, count(*) AS n FROM ops GROUP BY 1",
    "flow_columns": FLOW + "SELECT app_id, seq, target, op, col, CASE WHEN op = 'select' AND results IS NOT NULL THEN 90 ELSE 80 END::BIGINT AS conf, count(*) AS n FROM (SELECT *, unnest(cols) AS col FROM ops) GROUP BY ALL",
    "flow_context": FLOW + "SELECT key AS table_key, CASE WHEN confirmed THEN 'confirmado' ELSE 'desconocido' END AS context FROM ctx",
    "flow_roles": FLOW + f"SELECT app_id, target, role, {_STATUS}, (SELECT count(*) FROM ops WHERE ops.app_id = roles.app_id AND ops.target = roles.target AND op = 'select') AS n_reads, (SELECT count(*) FROM ops WHERE ops.app_id = roles.app_id AND ops.target = roles.target AND op <> 'select') AS n_writes FROM roles",
    "flow_role_counts": FLOW + f"SELECT place, d.role, count(roles.role) AS n FROM (SELECT unnest([{', '.join(_q(r) for r in ROLES)}]) AS role, unnest(range({len(ROLES)})) AS place) d LEFT JOIN roles ON roles.role = d.role GROUP BY ALL",
    "flow_bounded": FLOW + f"SELECT app_id, target, role, {_STATUS} FROM roles WHERE app_id = 7",
    "app_relations_strong": FLOW + "SELECT a.app_id AS producer, b.app_id AS consumer, count(*) AS n_tables FROM sides a JOIN sides b ON a.key = b.key AND a.app_id <> b.app_id WHERE a.p AND b.c GROUP BY ALL",
    "app_relations_weak": FLOW + "SELECT a.app_id AS app_a, b.app_id AS app_b, count(*) AS n_tables FROM sides a JOIN sides b ON a.key = b.key AND a.app_id < b.app_id WHERE NOT (a.p AND b.c) AND NOT (b.p AND a.c) GROUP BY ALL",
    "csharp_unknowns": """
        SELECT p_brand AS app_name, c || p_partkey AS class_name, 'Views/Main' || p_partkey || '.xaml.cs' AS file, reason
        FROM part, (SELECT unnest(['Main', 'Detail']) AS c), (SELECT unnest(['wpf_event_wiring_not_observable_in_cs', 'wpf_control_surface_not_observable_in_cs']) AS reason)""",
    "csharp_window_methods": """
        WITH e(class_name, method, what, target, status) AS (VALUES
            ('Main', 'Open', 'declared', NULL, NULL), ('Main', 'Refresh', 'declared', NULL, NULL), ('Main', 'Refresh', 'declared', NULL, NULL), ('Main', 'Inner', 'declared', NULL, NULL),
            ('Detail', 'Refresh', 'declared', NULL, NULL), ('Detail', 'Inner', 'declared', NULL, NULL),
            ('Main', 'Open', 'calls', 'Refresh', 'unresolved_call_target_ambiguous'), ('Main', 'Refresh', 'calls', 'Inner', 'resolved'), ('Detail', 'Refresh', 'calls', 'Inner', 'resolved'),
            ('Main', 'Open', 'shows', 'Detail', 'resolved'))
        SELECT p_brand AS app_name, 'Views/Main' || p_partkey || '.xaml.cs' AS file, CASE class_name WHEN 'Main' THEN 'Main' || p_partkey ELSE class_name END AS class_name, method, what, CASE what WHEN 'shows' THEN target || p_partkey ELSE target END AS target, status
        FROM part, e""",
    "search_indexed": "SELECT term, count(*) AS n, min(doc_id) AS first_id, sum(doc_id)::BIGINT AS sum_of_ids FROM documents, (SELECT unnest(['LICENSE', 'copy_ight', 'the%and', 'ed']) AS term) WHERE text ILIKE '%' || term || '%' GROUP BY 1",
    "line_containment": _CONTAINMENT,
    "maintained_roles": _WITHOUT_FIRST + f"SELECT app_id, target, role, {_STATUS}, (SELECT count(*) FROM ops WHERE ops.app_id = roles.app_id AND ops.target = roles.target AND op = 'select') AS n_reads, (SELECT count(*) FROM ops WHERE ops.app_id = roles.app_id AND ops.target = roles.target AND op <> 'select') AS n_writes FROM roles",
    "maintained_relations": _WITHOUT_FIRST + "SELECT a.app_id AS producer, b.app_id AS consumer, count(*) AS n_tables FROM sides a JOIN sides b ON a.key = b.key AND a.app_id <> b.app_id WHERE a.p AND b.c GROUP BY ALL",
    "app_reports": _REPORT,
    "app_workbooks": _SHEETS,
    "app_relation_evidence": _EVIDENCE + "SELECT * FROM rel",
    "diagram_relations": _RELATIONS_DIAGRAM,
    "app_relations_selfloop": FLOW + "SELECT app_id, count(*) AS n_tables FROM sides WHERE p AND c GROUP BY ALL",
    "app_relations_of_one": FLOW + "SELECT a.app_id AS producer, b.app_id AS consumer, count(*) AS n_tables FROM sides a JOIN sides b ON a.key = b.key AND a.app_id <> b.app_id WHERE a.p AND b.c AND (a.app_id = 7 OR b.app_id = 7) GROUP BY ALL",
    "sql_classified": FLOW + f"""
        SELECT category, target, is_procedure, count(*) AS n FROM (
          SELECT CASE WHEN sp THEN 'stored_procedure' ELSE 'query' END AS category, CASE WHEN sp THEN CASE WHEN q THEN raw ELSE regexp_extract(raw, '^\\s*(\\w+)', 1) END ELSE {_TABLE} END AS target, sp AS is_procedure
          FROM (SELECT raw, regexp_matches(trim(raw), '^\\[?(\\w+)\\]?\\.\\[?(\\w+)\\]?$') AS q, (is_sp OR NOT regexp_matches(raw, {_q(KEYWORDS)})) AND (regexp_matches(trim(raw), '^\\[?(\\w+)\\]?\\.\\[?(\\w+)\\]?$') OR regexp_matches(raw, '^\\s*(\\w+)\\s*(?:''|$)')) AS sp FROM f)) GROUP BY ALL""",
    "connection_strings": f"WITH {SETTINGS} SELECT app_id, server, database FROM cat",
    "footprint_counters": _FOOTPRINT + "SELECT count(*) AS total, count(*) FILTER (n = 1) AS resolved, count(*) FILTER (n > 1) AS ambiguous, count(*) FILTER (n IS NULL) AS unresolved, count(DISTINCT CASE WHEN n = 1 THEN server END) AS servers FROM j",
    "footprint_from_code": _CODE_FOOTPRINT + "SELECT *, CAST(CASE status WHEN 'resolved' THEN 95 WHEN 'unresolved_ambiguous_conditional' THEN 55 ELSE 20 END AS BIGINT) AS confidence FROM f",
    "footprint_code_counters": _CODE_FOOTPRINT + """
        SELECT count(DISTINCT app_name) AS total_apps, count(*) AS total_targets, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'unresolved_ambiguous_conditional') AS ambiguous,
               count(*) FILTER (status NOT IN ('resolved', 'unresolved_ambiguous_conditional')) AS unresolved, count(*) FILTER (is_erp) AS erp FROM f""",
    "batch_names": """
        SELECT o_orderkey, CASE WHEN root = module THEN root ELSE root || '/' || module END AS app_name
        FROM (SELECT o_orderkey, 'Root' || (o_custkey % 7) AS root, CASE WHEN o_orderkey % 2 = 0 THEN 'Root' ELSE 'Mod' END || (o_orderkey % 7) AS module FROM orders)""",
    "failure_reasons": """
        SELECT event_id, CASE event_type WHEN 'click' THEN 'SQL armado dinamicamente -- no se pudo determinar el texto completo.' WHEN 'view' THEN 'No se encontro la fuente de esta configuracion.' ELSE 'Causa no determinada.' END AS reason,
               CASE event_type WHEN 'click' THEN 'Revisar el codigo manualmente para confirmar el texto real de la consulta.' WHEN 'view' THEN 'Confirmar que la decompilacion incluyo todos los ensamblados relevantes (companion assemblies).' ELSE 'Revisar manualmente -- este es el residual honesto, no una clasificacion real.' END AS action FROM events""",
    "server_footprint": _FOOTPRINT + "SELECT app_id, target, CASE WHEN n = 1 THEN server END AS server, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM j",
    "cooccurrence_hot": """
        WITH u AS (SELECT c_nationkey || '.' || c_mktsegment AS key, c_custkey AS m FROM customer UNION ALL SELECT 'Calendar', c_custkey FROM customer WHERE c_custkey % 2 = 0),
        p AS (SELECT a.m AS app_id, b.m AS other, count(*) AS n FROM u a JOIN u b ON a.key = b.key AND a.m <> b.m GROUP BY ALL)
        SELECT app_id, count(*) AS n_partners, sum(n)::BIGINT AS n_shared FROM p GROUP BY 1""",
    "dep_table_edges": _portfolio("SELECT * FROM edges"),
    "dep_server_edges": f"WITH {SETTINGS} SELECT a.app_id AS app_a, b.app_id AS app_b, a.server AS resource FROM cat a JOIN cat b ON a.server = b.server AND a.app_name < b.app_name WHERE a.category = 'sql_or_oracle' AND b.category = 'sql_or_oracle'",
    "table_dictionary": _portfolio("SELECT schema_name, table_name, string_agg(app_name, ',' ORDER BY app_name, app_id) AS apps, count(*) AS app_count, count(DISTINCT coalesce(columns_json, '')) <= 1 AS schema_consistent, min(coalesce(columns_json, '')) AS columns FROM st JOIN apps USING (app_id) GROUP BY 1, 2"),
    "pattern_catalog": "WITH p(category, pattern) AS (VALUES "
    + ", ".join(f"({_q(n)}, {_q(p)})" for n, p in TEXT_PATTERNS)
    + "), m AS (SELECT doc_id AS id, source, category FROM documents JOIN p ON regexp_matches(text, pattern)), a AS (SELECT * FROM m UNION ALL SELECT doc_id, source, 'Sin categorizar' FROM documents WHERE doc_id NOT IN (SELECT id FROM m)) SELECT category, count(*) AS n_findings, count(DISTINCT source) AS n_apps, min(id) AS first_id FROM a GROUP BY 1",
    "factor_complexity": _factor("complejidad_tecnica"),
    "factor_risk": _factor("riesgo"),
    "factor_dependencies": _factor("dependencias"),
    "factor_rules": _factor("reglas_negocio"),
    "factor_integration": _factor("complejidad_integracion"),
    "factor_reuse": _factor("reutilizacion_potencial"),
    "factor_integration_labels": _portfolio(f"SELECT app_id, CASE operation {' '.join(f'WHEN {_q(o)} THEN {_q(g)}' for o, g in zip(IO_OPERATIONS, IO_GROUPS))} END AS label, count(*) AS n FROM io GROUP BY 1, 2"),
    "factor_sample_targets": _portfolio("SELECT app_id, string_agg(target, ',' ORDER BY target) AS targets FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY target) AS p FROM (SELECT DISTINCT app_id, target FROM sf)) WHERE p <= 8 GROUP BY 1"),
    "terciles": """
        WITH r AS (SELECT c_custkey, c_nationkey, CAST(CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_nationkey = 0 THEN 0 - floor(abs(c_acctbal) / 1000) ELSE floor(c_acctbal / 1000) END AS DOUBLE) AS raw FROM customer),
        l AS (SELECT c_nationkey, list_sort(list(raw)) AS v FROM r WHERE raw IS NOT NULL GROUP BY 1)
        SELECT c_custkey, r.c_nationkey, raw, CASE WHEN raw IS NULL THEN NULL WHEN v[-1] = 0 OR raw <= v[len(v) // 3 + 1] THEN 'Baja' WHEN raw <= v[len(v) * 2 // 3 + 1] THEN 'Media' ELSE 'Alta' END AS bucket
        FROM r LEFT JOIN l USING (c_nationkey)""",
    "priority_score": _portfolio("SELECT app_id, score, n_factors, CASE WHEN v[-1] = 0 OR score <= v[len(v) // 3 + 1] THEN 'Baja' WHEN score <= v[len(v) * 2 // 3 + 1] THEN 'Media' ELSE 'Alta' END AS bucket FROM scores, (SELECT list_sort(list(score)) AS v FROM scores)"),
    "priority_top_factors": _portfolio("SELECT app_id, place, factor, contribution FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY abs(contribution) DESC, factor) AS place FROM contrib WHERE contribution <> 0) WHERE place <= 2"),
    "app_listing": _portfolio("""SELECT app_id, app_name, coalesce(p, 0) AS sp_count, coalesce(t, 0) AS table_count, coalesce(p, 0) = 0 AND coalesce(t, 0) = 0 AS none_found FROM apps
        LEFT JOIN (SELECT app_id, count(DISTINCT target) AS p FROM sf WHERE category = 'stored_procedure' AND app_id % 3 <> 0 GROUP BY 1) USING (app_id) LEFT JOIN (SELECT app_id, count(*) AS t FROM st WHERE app_id % 6 <> 0 GROUP BY 1) USING (app_id)"""),
    "findings_left": _portfolio("SELECT id, cur.app_name, app_id, severity, CASE severity WHEN 'critica' THEN 0 WHEN 'alta' THEN 1 WHEN 'media' THEN 2 WHEN 'info' THEN 3 ELSE 99 END::BIGINT AS rank FROM cur LEFT JOIN apps USING (app_name)"),
    "sidebar_groups": """
        SELECT split_part(CASE WHEN o_orderkey % 11 = 0 THEN 'Solo' || o_orderkey ELSE 'Root' || (o_custkey % 97) || '/Mod' || o_orderkey END, '/', 1) AS family, count(*) AS members, count(*) FILTER (o_orderstatus = 'F') AS reviewed, max(o_orderdate) AS newest, count(*) >= 2 AS grouped
        FROM orders GROUP BY 1""",
    "search_target": _portfolio("SELECT DISTINCT app_id, target FROM sf WHERE target ILIKE '%t_1_1%%'"),
    "search_connection": f"WITH {SETTINGS} SELECT DISTINCT app_name, name FROM s WHERE value ILIKE '%srv1-%'",
    "security_password": f"WITH {SETTINGS} SELECT app_id, 'alta' AS severity, regexp_replace(value, '(?i)\\b(password|pwd)\\s*=\\s*[^;]+', '\\1=***', 'g') AS shown FROM s WHERE trim(regexp_extract(value, '(?i)(password|pwd)\\s*=\\s*([^;]+)', 2)) <> ''",
    "security_placeholder": f"WITH {SETTINGS} SELECT app_id, 'info' AS severity FROM s WHERE marked AND regexp_matches(trim(value), '^[a-z]{{4,10}}$')",
    "security_concat": FLOW + "SELECT app_id, count(*) AS n FROM f WHERE seq % 2 = 0 AND NOT is_sp AND NOT contains(raw, '@') GROUP BY 1",
    "setting_category": f"WITH {SETTINGS} SELECT app_id, category FROM cat",
    "io_labels_report": "SELECT ['Archivos', 'Red / HTTP', 'Impresion', 'Puerto serial', 'Proceso externo', 'Correo (SMTP)', 'Otro', 'Archivos', 'Otro'][event_id % 9 + 1] AS label, count(*) AS n FROM events GROUP BY 1",
    "io_labels_diagram": "SELECT ['Archivos / carpetas', 'Red (HTTP/SMTP)', 'Impresora', 'Puerto serial', 'Proceso externo', 'Red (HTTP/SMTP)', 'Reflection / COM', 'Archivos / carpetas', 'PLC / Modbus'][event_id % 9 + 1] AS label, count(*) AS n FROM events GROUP BY 1",
    "finding_categories": """
        WITH c AS (SELECT o_orderkey AS id, 'App' || (o_custkey % 100) AS app_name, unnest([['Inyeccion SQL / concatenacion sin parametros'], ['Credenciales en texto plano / hardcodeadas'], ['Manejo de errores silencioso'],
          ['Riesgo de caida por timer/thread sin manejo de excepciones'], ['Codigo muerto / nunca invocado'], ['Falta de transaccion / atomicidad'], ['Certificacion de operador nunca validada'], ['Falso exito / perdida silenciosa de datos'],
          ['Autenticacion debil / sin re-verificar permisos'], ['Contaminacion de decompilacion (proyecto ajeno)'], ['Bypass de autorizacion / control de permisos ausente'],
          ['Manejo de errores silencioso', 'Bypass de autorizacion / control de permisos ausente'], ['Sin categorizar']][o_orderkey % 13 + 1]) AS category FROM orders)
        SELECT category, count(*) AS n_findings, count(DISTINCT app_name) AS n_apps, min(id) AS first_id FROM c GROUP BY 1""",
    "object_names": "SELECT p_partkey, CASE WHEN p_partkey % 7 < 4 THEN 'dbo' END AS schema, CASE WHEN p_partkey % 7 < 4 THEN 'P' || p_partkey END AS name FROM part",
    "connection_kinds": f"WITH {SETTINGS} SELECT app_id, app_id % 8 IN (0, 1, 5) AS sql_server, 'no se pudo conectar' || CASE WHEN app_id % 2 = 0 THEN ' (SQLSTATE 08001)' ELSE '' END || ' — revisar con infraestructura/DBA' AS note FROM s",
    "confidence_lookup": "SELECT event_id, c AS confidence, CASE WHEN c <= 20 THEN 'unknown' WHEN c < 55 THEN 'low' WHEN c < 70 THEN 'medium' ELSE 'high' END AS label FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 90 WHEN 'view' THEN 70 WHEN 'signup' THEN 60 WHEN 'error' THEN 30 ELSE 20 END::BIGINT AS c FROM events)",
    "folder_class": "SELECT p_partkey, CASE WHEN p_size > 45 THEN 'APPLICATION' WHEN regexp_full_match(p_brand, 'Brand#1[0-9]|Brand#2') THEN 'THIRD_PARTY' ELSE 'UNKNOWN_COMPANION' END AS folder_class FROM part",
    "techstack": """
        WITH a AS (SELECT regexp_extract(url, '^(?:https?://)?([^/?#]*)', 1) AS app, bool_or(contains(html, '<script')) AS s, bool_or(contains(html, '<table')) AS t, bool_or(contains(html, '<form')) AS f, bool_or(contains(html, '<p')) AS p FROM pages GROUP BY 1)
        SELECT app, concat_ws(',', CASE WHEN f THEN 'Form' END, CASE WHEN p AND NOT t AND NOT f THEN 'Plain' END, CASE WHEN s THEN 'Script' END, CASE WHEN t THEN 'Table' END) AS stack FROM a""",
    "config_add_tags": "SELECT page_id, unnest(range(len(h))) AS place, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1) AS h FROM pages)",
    "dedupe_value": f"WITH {SETTINGS} SELECT trim(value) AS value, min(app_id) AS app_id FROM s WHERE trim(value) NOT IN (SELECT trim(c_mktsegment) FROM customer WHERE c_custkey % 9 = 0) GROUP BY 1",
    "upsert_identity": """
        WITH o AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 4 <> 0 THEN '/src/' || c_custkey END AS path FROM customer WHERE c_custkey % 3 <> 0),
        n AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN c_name || '-new' ELSE c_name END AS name, '/src/' || c_custkey AS path FROM customer WHERE c_custkey % 2 = 0),
        m AS (SELECT n.*, coalesce((SELECT min(id) FROM o WHERE o.path = n.path), (SELECT min(id) FROM o WHERE o.name = n.name)) AS id FROM n)
        SELECT o.id AS app_id, o.name AS app_name, m.path AS source_path, 'logica_revisada' AS review_status, 'updated' AS state FROM m JOIN o ON o.id = m.id
        UNION ALL SELECT NULL, name, path, 'borrador', 'added' FROM m WHERE id IS NULL
        UNION ALL SELECT id, name, path, 'logica_revisada', 'kept' FROM o WHERE id NOT IN (SELECT id FROM m WHERE id IS NOT NULL)""",
    "latest_activity": "SELECT user_id, event_id, event_type, CASE WHEN n <= 500 THEN 70 ELSE 60 END::BIGINT AS confidence FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS p FROM events) WHERE p = 1",
    "brace_depth": """
        SELECT conv_id, turn, CAST(sum(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN -1 ELSE 0 END) OVER w AS BIGINT) AS depth, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS last_user
        FROM (SELECT DISTINCT ON (conv_id, turn) conv_id, turn, role FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "dedupe_text_first": "SELECT conv_id, md5(text) AS digest, min(turn) AS turn FROM conversations GROUP BY 1, 2",
    "method_sql_map": """
        SELECT p_partkey AS method_id, count(*) AS n_findings, min(l_orderkey) AS first_finding FROM part JOIN lineitem ON p_partkey % 200 = l_partkey % 200 AND p_size % 7 = l_linenumber AND l_returnflag = 'A' GROUP BY 1""",
    "one_hop": """
        SELECT o_orderkey AS caller, count(*) AS n_operations, min(p_partkey) AS first_operation FROM orders JOIN part ON o_custkey % 50 = p_partkey % 50 AND o_orderkey % 40 = p_size % 40 WHERE o_orderkey % 3 <> 0 GROUP BY 1""",
    "companion_overlap": "WITH r AS (SELECT DISTINCT l_suppkey AS app_id, l_partkey FROM lineitem) SELECT a.app_id AS app_a, b.app_id AS app_b, count(*) AS n_shared FROM r a JOIN r b ON a.l_partkey = b.l_partkey AND a.app_id < b.app_id GROUP BY 1, 2",
    "snapshot_metrics": "SELECT event_type, count(*) AS total, count(*) FILTER (value < 10) AS low, count(*) FILTER (value >= 10 AND value < 50) AS mid, count(*) FILTER (value >= 50) AS high, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "priority_order": _portfolio("""SELECT app_id, score, row_number() OVER (ORDER BY score DESC, analyzed_at DESC NULLS LAST, app_id) AS place
        FROM scores LEFT JOIN (SELECT s_suppkey AS app_id, CASE WHEN s_nationkey % 5 <> 0 THEN '2024-01-0' || (s_nationkey % 3 + 1) END AS analyzed_at FROM supplier) USING (app_id)"""),
    "enrich_asked": """
        WITH o AS (SELECT DISTINCT l_suppkey % 50 AS app_id, l_linenumber <= 3 AS is_procedure, 'dbo' AS schema, 'obj' || l_partkey AS name FROM lineitem WHERE l_linenumber <> 7),
        c AS (SELECT s_suppkey AS app_id, k::BIGINT AS place, 'SRV' || (s_nationkey + k) AS server FROM supplier, range(2) AS r(k) WHERE s_suppkey < 50 AND (s_nationkey + k) % 7 <> 0)
        SELECT o.*, place, server FROM o JOIN c USING (app_id)""",
    "store_replaced": """
        WITH r AS (SELECT l_suppkey % 40 AS app_id, l_orderkey AS object, l_linenumber::BIGINT AS n FROM lineitem)
        SELECT app_id, object, n, NULL::VARCHAR AS missing FROM r WHERE app_id % 3 <> 0 OR app_id NOT IN (SELECT app_id FROM r WHERE n = 1)
        UNION ALL SELECT app_id, object, 100, NULL FROM r WHERE app_id % 3 = 0 AND n = 1""",
    "store_backfill": "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, CASE WHEN c_custkey % 2 = 0 THEN 'found ' || c_nationkey END) AS c_mktsegment, c_nationkey FROM customer",
    "store_latest_review": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1",
    "enrich_pick": "SELECT CASE WHEN l_linenumber <= 3 THEN 'procedure' ELSE 'table' END AS kind, 'obj' || l_partkey AS object, min(CASE WHEN l_linenumber <= 3 OR l_returnflag = 'N' THEN l_suppkey END) AS connection FROM lineitem GROUP BY 1, 2",
    "diagram_classes": _portfolio(_CLASSES_DIAGRAM),
    "diagram_top_nodes": _portfolio("""
        SELECT class_name, kind, target FROM (SELECT *, sum(c) OVER o + sum(r) OVER o - r AS n FROM (
          SELECT *, CASE WHEN row_number() OVER (PARTITION BY class_name ORDER BY kind, target) = 1 THEN 1 ELSE 0 END AS c, CASE WHEN row_number() OVER (PARTITION BY kind, target ORDER BY class_name) = 1 THEN 1 ELSE 0 END AS r
          FROM (SELECT DISTINCT 'Class' || app_id AS class_name, category AS kind, target FROM sf)) WINDOW o AS (ORDER BY class_name, kind, target)) WHERE n < 80"""),
    "ranked_findings_first": "SELECT l_orderkey, l_returnflag, l_linenumber, l_suppkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_suppkey, l_partkey) AS p FROM lineitem) WHERE p = 1",
    "flow_key_roles": KEYED + f"SELECT app_id, key AS table_key, role, {_STATUS}, n_reads, n_writes FROM keyed",
    "flow_grouped": FLOW + f"SELECT target AS section, list_position([{', '.join(_q(r) for r in ROLES)}], role)::BIGINT AS place, app_id, role FROM roles",
    "data_op_roles": KEYED + "SELECT f.app_id, coalesce(role, 'indeterminado') AS role, count(*) AS n FROM f LEFT JOIN keyed ON keyed.app_id = f.app_id AND f.seq % 4 <> 0 AND keyed.key = regexp_replace(upper(f.target), '^DBO\\.', '') WHERE f.seq % 2 = 0 GROUP BY ALL",
    "enrich_counters": "SELECT l_suppkey AS app_id, count(*) FILTER (l_linenumber <= 3 AND l_returnflag = 'N') AS sp_ok, count(*) FILTER (l_linenumber <= 3) AS sp_total, count(*) FILTER (l_linenumber > 3) AS tables FROM lineitem GROUP BY 1",
    "folder_diff": "SELECT DISTINCT p_brand AS app_name, p_type AS folder FROM part p WHERE p_size > 25 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_type = p.p_type AND q.p_size <= 25)",
    "csharp_techstack": "SELECT DISTINCT p_brand AS app_name, 'WinForms' AS ui_framework, 'System.Data.SqlClient (SQL Server)' AS db_drivers FROM part",
    "csharp_snapshot": "SELECT 'SqlCommand' AS kind, 4 * count(*) AS total, 2 * count(*) AS unknown, 0::BIGINT AS low, 0::BIGINT AS medium, 2 * count(*) AS high, count(DISTINCT p_brand) AS members FROM part",
    "assembly_observations": _portfolio(
        "SELECT 'Lib' || l_partkey AS assembly, chr(39) || own || chr(39) || ' reutiliza el ensamblado ' || chr(39) || 'Lib' || l_partkey || chr(39) || ', tambien encontrado en: ' || names || '.' AS text FROM ("
        "SELECT l.l_partkey, min(m.app_name) AS own, string_agg(DISTINCT o.app_name, ', ' ORDER BY o.app_name) AS names FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = 7) a"
        " JOIN lineitem l ON l.l_partkey = a.l_partkey AND l.l_suppkey <> 7 JOIN apps o ON o.app_id = l.l_suppkey JOIN apps m ON m.app_id = 7 GROUP BY 1)"
    ),
    "decision_factors": _DECISION + "SELECT app_id, d.place, label, d.bucket, raw, coalesce(t.text, 'No se puede interpretar todavia -- falta evidencia (ver columna Evidencia).') AS interpretation FROM d LEFT JOIN t ON t.place = d.place AND t.bucket = d.bucket",
    "decision_evidence": _DECISION + """
        SELECT app_id, factor, CASE WHEN raw IS NULL THEN 'Sin evidencia disponible'
          WHEN place = 1 THEN n_targets || ' consulta(s)/SP, ' || n_tables || ' tabla(s) introspectada(s)'
          WHEN place = 2 THEN CASE WHEN n_risks = 0 THEN 'Sin hallazgos ni flags de seguridad detectados' ELSE n_risks || ' hallazgo(s)/flag(s)' || CASE WHEN n_critical > 0 THEN ' (' || n_critical || ' critico(s))' ELSE '' END END
          WHEN place = 3 THEN CASE WHEN raw = 0 THEN 'No comparte tablas/SP ni servidor con otras apps' ELSE 'comparte ' || raw::BIGINT || ' recurso(s) (tabla/SP/servidor) con otras apps' END
          WHEN place = 4 THEN raw::BIGINT || ' linea(s) documentadas (proxy)'
          WHEN place = 5 THEN coalesce(kinds, 'Sin integraciones externas detectadas')
          ELSE CASE WHEN n_patterns IS NULL THEN 'No comparte patrones conocidos con otras apps' ELSE 'comparte ' || n_patterns || ' patron(es) con otras apps' END END AS evidence
        FROM d JOIN (SELECT app_id, (SELECT count(DISTINCT target) FROM sf WHERE sf.app_id = apps.app_id) AS n_targets, (SELECT count(*) FROM st WHERE st.app_id = apps.app_id) AS n_tables,
          (SELECT count(*) FROM cur WHERE cur.app_name = apps.app_name) + (SELECT count(*) FROM flags WHERE flags.app_id = apps.app_id) AS n_risks, (SELECT count(*) FROM cur WHERE cur.app_name = apps.app_name AND severity = 'critica') AS n_critical FROM apps) USING (app_id)
        LEFT JOIN (SELECT app_id, string_agg(n || ' integracion(es) de tipo ''' || label || '''', ', ' ORDER BY n DESC, label) AS kinds FROM (SELECT app_id, ['Archivos', 'Red / HTTP', 'Impresion', 'Puerto serial', 'Proceso externo', 'Correo (SMTP)', 'Otro', 'Archivos', 'Otro'][id % 9 + 1] AS label, count(*) AS n FROM io GROUP BY ALL) GROUP BY 1) USING (app_id)
        LEFT JOIN (SELECT app_id, count(*) AS n_patterns FROM members JOIN (SELECT category FROM members GROUP BY 1 HAVING count(*) > 1) USING (category) JOIN apps USING (app_name) GROUP BY 1) USING (app_id)""",
    "decision_summary": _DECISION + """,
        g AS (SELECT app_id, max(bucket) FILTER (place = 1) AS technical, max(bucket) FILTER (place = 5) AS integration, max(bucket) FILTER (place = 2) AS risk,
          concat_ws(', ', string_agg(label, ', ' ORDER BY place) FILTER (bucket IS NULL), 'Cantidad de usuarios', 'Criticidad operacional') AS pending,
          list(label || ' en nivel ' || bucket || ' (' || CASE WHEN contribution > 0 THEN 'subio' ELSE 'bajo' END || ' el score en ' || abs(contribution) || ')' ORDER BY abs(contribution) DESC, place) FILTER (contribution <> 0) AS moves,
          concat_ws('; ', max('el riesgo (hallazgos/flags de seguridad) es alto y deberia revisarse antes de comprometer fecha de migracion') FILTER (place = 2 AND bucket = 'Alta'), max('esta muy interconectada con otras apps, lo que puede forzar una migracion coordinada en vez de aislada') FILTER (place = 3 AND bucket = 'Alta')) AS risks,
          concat_ws('; ', max('comparte patrones conocidos con otras apps, lo que abarata construir una solucion reutilizable') FILTER (place = 6 AND bucket = 'Alta'), max('su superficie tecnica de datos es pequena') FILTER (place = 1 AND bucket = 'Baja'), max('no depende de integraciones externas complejas') FILTER (place = 5 AND bucket = 'Baja')) AS strengths
          FROM d GROUP BY 1),
        x AS (SELECT app_id, app_name, score, CASE WHEN v[-1] = 0 OR score <= v[len(v) // 3 + 1] THEN 'Baja' WHEN score <= v[len(v) * 2 // 3 + 1] THEN 'Media' ELSE 'Alta' END AS priority,
          CASE review_status WHEN 'borrador' THEN 'Sin revision de logica de negocio todavia' ELSE 'Logica de negocio revisada' END AS readiness FROM scores JOIN apps USING (app_id), (SELECT list_sort(list(score)) AS v FROM scores))
        SELECT app_id, app_name, priority, score, technical, integration, risk, readiness, pending,
          'Esta app quedo con prioridad **' || priority || '** (score ' || score || '). ' || CASE WHEN len(moves) > 0 THEN 'El/los factor(es) con mayor influencia en el score fueron ' || array_to_string(moves[1:2], ' y ') || '.' ELSE 'Ningun factor tuvo un aporte distinto de cero para esta app -- valores parejos frente al resto del portafolio.' END || ' Informacion que aun falta para completar la evaluacion: ' || pending || '.' AS narrative,
          'Prioridad recomendada: ' || priority || '. Principal(es) riesgo(s): ' || coalesce(nullif(risks, ''), 'no se detectaron riesgos dominantes con la evidencia disponible hoy') || '. Principal(es) fortaleza(s): ' || coalesce(nullif(strengths, ''), 'ninguna fortaleza clara segun los factores calculados hoy') || '. Pendiente de evaluar antes de decidir: ' || pending || '. Estado de revision de logica de negocio: ' || readiness || '.' AS conclusion
        FROM g JOIN x USING (app_id)""",
}


# ---- what the rendered source files hold, by the rendering's own rules

_PARTS = "p AS (SELECT p_partkey AS p, p_brand AS app_name, 'Form' || p_partkey AS class_name, 'Screens/Form' || p_partkey || '.cs' AS file FROM part)"


def _values(names: str, rows: list[str], shown: str, join: str = "", where: str = "") -> str:
    """Rows of each part: ``rows`` of VALUES over columns of p, as columns ``names``."""
    union = " UNION ALL ".join(f"SELECT p.*, {', '.join(f'{v} AS {n}' for n, v in zip(names.split(', '), row))} FROM p" for row in rows)  # type: ignore[arg-type]
    return f"WITH {_PARTS}, v AS ({union}) SELECT {shown} FROM v {join} {where}"


_N = "CAST(NULL AS VARCHAR)"
_SQL = [
    ("'Load'", "'SqlCommand'", "'query'", "'Part_' || p", "false", "'@id <- id'", "'A|B'", "'SELECT A, B FROM Part_' || p || ' WHERE id = {id}'", "80", "13", "'select'"),
    ("'Save'", "'SqlCommand'", "'stored_procedure'", "'SaveProc_' || p", "true", "''", "''", _N, "20", "NULL", "'stored_procedure'"),
    ("'Branch'", "'SqlCommand'", "'query'", _N, "false", "''", "''", _N, "20", "NULL", _N),
    ("'Build'", "'SqlCommand'", "'query'", "'Table_' || p", "false", "''", "''", "'UPDATE Table_' || p || ' SET \"X\" = 1' || chr(10) || 'WHERE id = {id}'", "80", "42", "'update'"),
]
_SQL_NAMES = "method, kind, category, target, is_stored_procedure, parameters, result_columns, resolved, confidence, source_line, operation"
_KNOWN = "LEFT JOIN (SELECT p AS q, app_name AS qa FROM p) n ON n.q = v.p + 1 AND n.qa = v.app_name"

ORACLES |= {
    "csharp_sql_findings": _values(_SQL_NAMES, _SQL, "app_name, file, class_name, method, kind, category, target, is_stored_procedure, parameters, result_columns"),
    "csharp_reconstruct": _values(_SQL_NAMES, _SQL, "app_name, file, method, resolved, CAST(confidence AS BIGINT) AS confidence, CAST(source_line AS BIGINT) AS source_line"),
    "csharp_io": _values("method, operation, category", [("'Save'", "'File.WriteAllText'", "'io'"), ("'Build'", "'MethodInfo.Invoke'", "'reflection'")], "app_name, file, class_name, method, operation, category"),
    "csharp_structure": f"""WITH {_PARTS} SELECT app_name, file, class_name, 'App.Screens' AS namespace, 'Form' AS base_type, 'form' AS class_type, CASE WHEN p % 2 = 0 THEN 8 ELSE 7 END::BIGINT AS n_methods FROM p
        UNION ALL SELECT app_name, 'Program' || p || '.cs', 'Program', 'App', NULL, 'class', 1 FROM p WHERE p % 10 = 0""",
    "csharp_entry_points": f"WITH {_PARTS} SELECT app_name, 'Program' || p || '.cs' AS file, 'Program' AS class_name, 'Main' AS method, 'application_run' AS pattern, 95::BIGINT AS confidence FROM p WHERE p % 10 = 0",
    "csharp_navigation": _values(
        "target_class, operation, known", [("'Form' || (p + 1)", "'show_dialog'", "1"), ("'Missing'", "'show'", "0"), (_N, "'show'", "0")],
        "app_name, class_name, 'btnSave_Click' AS method, target_class, operation, CASE WHEN target_class IS NULL THEN 'unresolved_navigation_target_unknown' WHEN known = 1 AND q IS NOT NULL THEN 'resolved' ELSE 'unresolved_target_not_a_known_screen' END AS status, CASE WHEN target_class IS NULL THEN 30 WHEN known = 1 AND q IS NOT NULL THEN 90 ELSE 50 END::BIGINT AS confidence", _KNOWN,
    ),
    "csharp_events": _values("event, handler, status", [("'Click'", "'btnSave_Click'", "'resolved'"), ("'Enter'", "'Save'", "'resolved'"), ("'Leave'", _N, "'unresolved_event_handler_unknown'")], "app_name, class_name, 'btnSave' AS control, event, handler, status"),
    "csharp_controls": _values("control, control_type, label, status", [("'btnSave'", "'Button'", "'Save ' || p", "'resolved'"), ("'lblName'", "'Label'", _N, "'resolved'"), ("'odd'", _N, _N, "'unresolved_control_type_unknown'")], "app_name, class_name, control, control_type, label, status"),
    "csharp_calls": _values(
        "caller, target_method, resolution_status, n", [("'Load'", "'Save'", "'resolved'", "1"), ("'Load'", "'Helper'", "CASE WHEN p % 2 = 0 THEN 'unresolved_call_target_ambiguous' ELSE 'resolved' END", "1"), ("'Load'", _N, "'unresolved_call_target_unknown'", "2"), ("'InitializeComponent'", "'Save'", "'resolved'", "1")],
        "app_name, class_name, caller, target_method, resolution_status, CAST(n AS BIGINT) AS n",
    ),
    "csharp_data_ops": _values(
        "method, operation, distance, confidence", [("'Load'", "'select Part_' || p", "'direct'", "90"), ("'Save'", "'stored_procedure SaveProc_' || p", "'direct'", "90"), ("'Build'", "'update Table_' || p", "'direct'", "90"), ("'Load'", "'stored_procedure SaveProc_' || p", "'one_hop'", "70"), ("'InitializeComponent'", "'stored_procedure SaveProc_' || p", "'one_hop'", "70")],
        "class_name, method, operation, distance, CAST(confidence AS BIGINT) AS confidence",
    ),
    "csharp_settings": """
        WITH p AS (SELECT p_partkey AS p, 'App' || p_partkey AS app_name FROM part)
        SELECT app_name, 'Properties/Settings.cs' AS file, 5::BIGINT AS line, 'Main' || p AS name, 'Data Source=srv' || p || ';Initial Catalog=Db' AS value, true AS marked, 'sql_or_oracle' AS category FROM p
        UNION ALL SELECT app_name, 'Properties/Settings.cs', 13, 'Folder', 'C:\\Data\\' || p, false, 'local_path' FROM p
        UNION ALL SELECT app_name, 'app.config', 6, 'Other', 'server=other' || p, true, 'sql_or_oracle' FROM p WHERE p % 5 <> 0""",
}
