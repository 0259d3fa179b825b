"""What is expected of each part's application, with {p} for the part and {type} for its type: the lines of its report and when they are there; the rows of its workbook."""

REPORT = (
    ("true", "# App{p} — Inventario automatico (borrador)"),
    ("true", ""),
    ("true", "> Generado por portolan. Este es un primer borrador — revisar antes de usarlo como fuente final."),
    ("true", ""),
    ("true", "## Ciclo de vida"),
    ("true", ""),
    ("true", "- **Build date** (proxy, fecha de modificacion del ensamblado): 2024-01-02"),
    ("true", "- **Last activity evidence**: unknown"),
    ("true", "- **Activity source**: no_evidence"),
    ("true", "- **Activity confidence**: unknown"),
    ("true", ""),
    ("true", "## Tecnologia"),
    ("true", ""),
    ("true", "- **Lenguaje**: C#"),
    ("true", "- **Target .NET**: net48"),
    ("true", "- **UI Framework**: WinForms"),
    ("true", "- **Drivers de BD detectados**: SQL Server, Oracle"),
    ("p_partkey % 2 = 0", "- **Ensamblados adicionales decompilados** (referenciados por el .exe, ej. una ClassLib con settings/logica propia): Own.dll"),
    ("true", ""),
    ("p_partkey % 3 = 0", "## ⚠️ Alertas de seguridad"),
    ("p_partkey % 3 = 0", ""),
    ("p_partkey % 3 = 0", "| Severidad | Descripcion | Ubicacion |"),
    ("p_partkey % 3 = 0", "|---|---|---|"),
    ("p_partkey % 3 = 0", "| alta | a\\|b {type} | line 1 line 2 |"),
    ("p_partkey % 3 = 0", ""),
    ("true", "## Connection strings"),
    ("true", ""),
    ("true", "| Setting | Valor por defecto | Archivo | Evidencia | Confianza |"),
    ("true", "|---|---|---|---|---|"),
    ("true", "| `Main{p}` | `Data Source=srv{p};Initial Catalog=Db` | Properties/Settings.cs | SETTINGS, linea 5 | 95% |"),
    ("p_partkey % 5 <> 0", "| `Other` | `server=other{p}` | app.config | SETTINGS, linea 6 | 95% |"),
    ("true", ""),
    ("true", "## Rutas / archivos locales configurados"),
    ("true", ""),
    ("true", "| Setting | Valor por defecto |"),
    ("true", "|---|---|"),
    ("true", "| `Folder` | `C:\\Data\\{p}` |"),
    ("true", ""),
    ("true", "## Funciones -> SQL / Stored Procedures"),
    ("true", ""),
    ("true", '<div class="table-sql-findings" markdown="1">'),
    ("true", ""),
    ("true", "| Clase | Funcion | Conexion | Tipo | Tabla / SP | SQL / Query | Parametros | Columnas de resultado | Evidencia | Confianza |"),
    ("true", "|---|---|---|---|---|---|---|---|---|---|"),
    ("true", '| `Store` | `Direct` | old | Query | Direct_{p} | `using (SqlConnection cn = new SqlConnection(Properties.Settings.Default.Main{p})) { SqlCommand cmd = new SqlCommand("UPDATE Direct_{p} SET A = 1", cn);` |  |  |  | 20% |'),
    ("true", '| `Store` | `Direct` | old | Query | Direct_{p} | `SqlCommand cmd = new SqlCommand("UPDATE Direct_{p} SET A = 1", cn);` |  |  |  | 20% |'),
    ("true", '| `Store` | `Passed` | ? | Query | Passed_{p} | `cmd.CommandText = "INSERT INTO Passed_{p} (A) VALUES (1)";` |  |  |  | 20% |'),
    ("true", '| `Store` | `Choice` | ? | Query | Choice_{p} | `SqlCommand cmd = new SqlCommand("SELECT A FROM Choice_{p}", cn);` |  |  |  | 20% |'),
    ("true", '| `Store` | `Branches` | cs | Query | Branches_{p} | `SqlCommand cmd = new SqlCommand("DELETE FROM Branches_{p} WHERE A = 1", cn);` |  |  |  | 20% |'),
    ("true", '| `Store` | `Guarded` | cs | Query | Guarded_{p} | `cmd.CommandText = "SELECT A FROM Guarded_{p}";` |  |  |  | 20% |'),
    ("true", '| `Store` | `Shared` | shared | Query | Shared_{p} | `SqlCommand cmd = new SqlCommand("SELECT A FROM Shared_{p}", new SqlConnection(shared));` |  |  |  | 20% |'),
    ("true", '| `Store` | `Written` | ? | Query | ? | `SqlConnection cn = new SqlConnection("Server=lab{p};Database=Lab");` |  |  |  | 20% |'),
    ("true", '| `Store` | `Written` | ? | Query | Written_{p} | `SqlCommand cmd = new SqlCommand("SELECT A FROM Written_{p}", cn);` |  |  |  | 20% |'),
    ("true", '| `Store` | `Built` | ? | Query | ? | `OracleConnection cn = new OracleConnection("Data Source=" + host);` |  |  |  | 20% |'),
    ("true", '| `Store` | `Built` | ? | Query | Built_{p} | `OracleCommand cmd = new OracleCommand("SELECT A FROM Built_{p}", cn);` |  |  |  | 20% |'),
    ("true", '| `Store` | `Ledger` | Settings.Default.Other | Query | GL_LINES | `OracleCommand cmd = new OracleCommand("SELECT A FROM GL_LINES", new OracleConnection(Settings.Default.Other));` |  |  |  | 20% |'),
    ("true", ""),
    ("true", "</div>"),
    ("true", ""),
    ("p_partkey % 4 = 0", "## Extraccion de esquema desde la base de datos (solo lectura)"),
    ("p_partkey % 4 = 0", ""),
    ("p_partkey % 4 = 0", "### Esquema de tablas"),
    ("p_partkey % 4 = 0", ""),
    ("p_partkey % 4 = 0", "#### `dbo.Direct_{p}`"),
    ("p_partkey % 4 = 0", ""),
    ("p_partkey % 4 = 0", "| Columna | Tipo | Nulo | Longitud | Default |"),
    ("p_partkey % 4 = 0", "|---|---|---|---|---|"),
    ("p_partkey % 4 = 0", "| A | int | NO |  | (0) |"),
    ("p_partkey % 4 = 0", ""),
    ("p_partkey % 4 = 0", "Claves foraneas:"),
    ("p_partkey % 4 = 0", "- `A` -> `dbo.R.B` (`fk`)"),
    ("p_partkey % 4 = 0", ""),
    ("true", "## Archivos, impresoras, procesos y red en codigo"),
    ("true", ""),
    ("true", "_No se detecto acceso directo a archivos/carpetas, impresoras (BarTender/PrintDocument), puertos seriales, otros ejecutables (Process.Start) o llamadas HTTP/SMTP en el codigo._"),
    ("true", ""),
    ("true", "## Invocacion indirecta / tardia (Reflection, COM)"),
    ("true", ""),
    ("true", "_No se detecto invocacion via Reflection (MethodInfo.Invoke, Activator.CreateInstance) ni COM/CLSID (Marshal.GetTypeFromCLSID) en el codigo._"),
    ("true", ""),
)

#: Title of a sheet, when the row is there, and its cells.
SHEETS = (
    ("Tecnologia", "true", ("Campo", "Valor")),
    ("Tecnologia", "true", ("Lenguaje", "C#")),
    ("Tecnologia", "true", ("Target .NET", "net48")),
    ("Tecnologia", "true", ("UI Framework", "WinForms")),
    ("Tecnologia", "true", ("Drivers de BD", "SQL Server, Oracle")),
    ("Tecnologia", "p_partkey % 2 = 0", ("Ensamblados adicionales decompilados", "Own.dll")),
    ("Seguridad", "true", ("Severidad", "Descripcion", "Ubicacion")),
    ("Seguridad", "p_partkey % 3 = 0", ("alta", "a|b {type}", "line 1\nline 2")),
    ("Conexiones y config", "true", ("Setting", "Valor por defecto", "Archivo", "Categoria", "Extractor", "Linea", "Confianza")),
    ("Conexiones y config", "true", ("Main{p}", "Data Source=srv{p};Initial Catalog=Db", "Properties/Settings.cs", "sql_or_oracle", "SETTINGS", "5", "95")),
    ("Conexiones y config", "true", ("Folder", "C:\\Data\\{p}", "Properties/Settings.cs", "local_path", "SETTINGS", "13", "95")),
    ("Conexiones y config", "p_partkey % 5 <> 0", ("Other", "server=other{p}", "app.config", "sql_or_oracle", "SETTINGS", "6", "95")),
    ("Funciones-SQL-SP", "true", ("Clase", "Funcion", "Conexion", "Tipo", "Tabla o SP", "SQL / Query", "Parametros", "Columnas resultado", "Extractor", "Linea", "Confianza")),
    *[
        ("Funciones-SQL-SP", "true", ("Store", method, connection, "Query", target, text, "", "", "", "", "20"))
        for method, connection, target, text in (
            ("Direct", "old", "Direct_{p}", 'using (SqlConnection cn = new SqlConnection(Properties.Settings.Default.Main{p})) { SqlCommand cmd = new SqlCommand("UPDATE Direct_{p} SET A = 1", cn);'),
            ("Direct", "old", "Direct_{p}", 'SqlCommand cmd = new SqlCommand("UPDATE Direct_{p} SET A = 1", cn);'),
            ("Passed", "?", "Passed_{p}", 'cmd.CommandText = "INSERT INTO Passed_{p} (A) VALUES (1)";'),
            ("Choice", "?", "Choice_{p}", 'SqlCommand cmd = new SqlCommand("SELECT A FROM Choice_{p}", cn);'),
            ("Branches", "cs", "Branches_{p}", 'SqlCommand cmd = new SqlCommand("DELETE FROM Branches_{p} WHERE A = 1", cn);'),
            ("Guarded", "cs", "Guarded_{p}", 'cmd.CommandText = "SELECT A FROM Guarded_{p}";'),
            ("Shared", "shared", "Shared_{p}", 'SqlCommand cmd = new SqlCommand("SELECT A FROM Shared_{p}", new SqlConnection(shared));'),
            ("Written", "?", "?", 'SqlConnection cn = new SqlConnection("Server=lab{p};Database=Lab");'),
            ("Written", "?", "Written_{p}", 'SqlCommand cmd = new SqlCommand("SELECT A FROM Written_{p}", cn);'),
            ("Built", "?", "?", 'OracleConnection cn = new OracleConnection("Data Source=" + host);'),
            ("Built", "?", "Built_{p}", 'OracleCommand cmd = new OracleCommand("SELECT A FROM Built_{p}", cn);'),
            ("Ledger", "Settings.Default.Other", "GL_LINES", 'OracleCommand cmd = new OracleCommand("SELECT A FROM GL_LINES", new OracleConnection(Settings.Default.Other));'),
        )
    ],
    ("Archivos-Impresoras-Red", "true", ("Clase", "Funcion", "Operacion", "Detalle")),
    ("Esquema tablas (BD)", "p_partkey % 4 = 0", ("Tabla", "Columna", "Tipo", "Nulo", "Longitud", "Default")),
    ("Esquema tablas (BD)", "p_partkey % 4 = 0", ("dbo.Direct_{p}", "A", "int", "NO", "", "(0)")),
    ("Claves foraneas (BD)", "p_partkey % 4 = 0", ("Tabla", "Columna", "Tabla referida", "Columna referida", "FK")),
    ("Claves foraneas (BD)", "p_partkey % 4 = 0", ("dbo.Direct_{p}", "A", "dbo.R", "B", "fk")),
)
