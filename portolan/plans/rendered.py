"""Findings, settings and applications rendered from the tables of a data folder, so that the operators have whole tables to work on.

The same rendering stands in ``oracles`` as SQL; the templates are shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statements by number, with {t} for the table; between them they reach every row of the role table.
TEMPLATES = (
    "INSERT INTO {t} (IL, ReflA, Serial_Number) VALUES (@a, @b, @c)",
    "UPDATE {t} SET STATUS = @s, DEVICE = @d WHERE ID = @id",
    "insert into {t} ([STATUS], WAVE) OUTPUT inserted.ID values (1, 2)",
    "SELECT ILEndA, g.ILEndB AS b FROM {t} g",
    "select TOP 10 TEST_DATE, STATUS from {t}",
    "SELECT STATUS, DEVICE FROM {t}",
    "SELECT Customer, ISNULL(Price, Backup, 0), Qty FROM {t}",
    "DELETE FROM {t} WHERE ID = 1",
    "INSERT INTO {t} SELECT * FROM Other",
    "SELECT * FROM {t}",
    "UPDATE {t} \\r\\n SET ILPassLimit = 1, RLPassLimit = x",
    "MERGE INTO {t} AS x USING y",
    "EXEC {t}",
    "SELECT Serial, ISNULL(UPPER(a), y, z), CONVERT(int, SUBSTRING(b, 1, LEN(c))), Wave FROM {t}",
)

#: What curated findings say.
TITLES = (
    "Inyeccion SQL en el buscador", "Password en texto plano", "Error silenciado en la carga", "Metodo async void en el timer", "Codigo muerto", "Alta sin transaccion", "Lee cert_end_date y sigue",
    "Falso exito al guardar", "No distingue nivel de usuario", "Proyecto contaminado", "Bypass del login", "Sin autorizacion, y oculta todo fallo", "Revisar nombres",
)

#: Categories of text and their patterns.
TEXT_PATTERNS = [("license", r"(?i)licen[sc]e"), ("numbers", r"[0-9]{5}"), ("mail", r"[a-z0-9]@[a-z]"), ("shouting", "[A-Z]{6}"), ("markup", "[<>]"), ("key", r"(?i)(secret|token|api.?key)")]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def spread(frame: DataFrame) -> DataFrame:
    """``frame`` on all cores, where it is read in fewer parts than there are (a single small file); else as it is."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def chosen(number: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), number.cast("int") + 1)


def template_number(part: str = "l_partkey") -> Column:
    k = (F.col("l_suppkey") + F.col("l_linenumber") * 3) % len(TEMPLATES)
    return F.when(k.isin(0, 3, 4) & (F.col(part) % 4 == 0), 6).otherwise(k)


def flow_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item as a SQL finding of its order on its part."""
    rows = spread(table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")).withColumn("k", template_number())
    target = F.concat(chosen(F.col("l_linenumber") % 3, ("dbo.Part_", "part_", "Part_")), F.col("l_partkey").cast("string"))
    results = F.when((F.col("k") == 9) & (F.col("l_linenumber") % 2 == 0), '["STATUS","TEST_DATE"]').when((F.col("k") == 9) & (F.col("l_linenumber") == 5), "not json").otherwise("[]")
    rows = rows.withColumn("target", target)
    return rows.select(F.col("l_orderkey").alias("app_id"), F.col("l_linenumber").alias("seq"), "target", (F.col("k") == 12).alias("is_sp"), F.lit(None).cast("string").alias("resolved"), F.replace(chosen(F.col("k"), TEMPLATES), F.lit("{t}"), F.col("target")).alias("raw"), results.alias("result_columns"))


def supplier_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item as a finding of its supplier on a target of its part and line."""
    rows = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_linenumber")
    return rows.select(F.col("l_suppkey").alias("app_id"), F.concat_ws("_", F.lit("T"), "l_partkey", "l_linenumber").alias("target"), chosen(F.col("l_linenumber") % 5, ("oracle_package_call", "stored_procedure", "query", "query", "query")).alias("category"))


def supplier_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of each supplier, with columns as the application saw them."""
    rows = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_returnflag")
    rows = rows.select(F.col("l_suppkey").alias("app_id"), F.col("l_returnflag").alias("schema_name"), F.concat(F.lit("P_"), (F.col("l_partkey") % 50).cast("string")).alias("table_name")).distinct()
    return rows.withColumn("columns_json", F.when(F.col("app_id") % 7 == 0, F.when(F.col("table_name") == "P_3", None).otherwise('["A"]')).when(F.col("table_name").isin("P_1", "P_2"), '["B"]').otherwise('["A"]'))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as applications, with review notes."""
    notes = F.when(F.col("s_suppkey") % 4 == 0, None).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.col("s_suppkey").cast("int") % 9), lambda i: F.when(i % 3 == 2, "  ").otherwise(F.concat(F.lit("rule "), i.cast("string")))), "\n"))
    rows = table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    return rows.select(F.col("s_suppkey").alias("app_id"), F.col("s_name").alias("app_name"), F.when(F.col("s_suppkey") % 5 == 0, "borrador").otherwise("logica_revisada").alias("review_status"), notes.alias("review_notes"))


def severity_of(priority: str = "o_orderpriority") -> Column:
    return F.when(F.col(priority) == "1-URGENT", "critica").when(F.col(priority) == "2-HIGH", "alta").when(F.col(priority) == "3-MEDIUM", "media").when(F.col(priority) == "5-LOW", "info").otherwise("rara")


def curated_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a curated finding of a customer's application; every seventh names one that isn't there."""
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    name = F.concat(F.when(F.col("o_orderkey") % 7 == 0, "Gone#").otherwise("Supplier#"), F.lpad((F.col("o_custkey") % 100).cast("string"), 9, "0"))
    return rows.select(F.col("o_orderkey").alias("id"), name.alias("app_name"), severity_of().alias("severity"))


def security_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned line items as automatic flags of their supplier."""
    rows = table(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag", "l_linenumber").filter("l_returnflag = 'R'")
    return rows.select(F.col("l_suppkey").alias("app_id"), chosen(F.col("l_linenumber") % 3, ("alta", "media", "info")).alias("severity"))


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's setting: connections with and without password, paths, placeholders."""
    rows = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment").withColumn("k", F.col("c_custkey") % 8)
    server = F.concat(F.lit("SRV"), F.col("c_nationkey").cast("string"), F.lit("-"), (F.col("c_custkey") % 101).cast("string"))
    value = (
        F.when(F.col("k") == 0, F.concat(F.lit("Data Source="), server, F.lit(";Initial Catalog=Db;User Id=u;Password=pw"), F.col("c_custkey").cast("string")))
        .when(F.col("k") == 1, F.concat(F.lit("server = "), F.lower(server), F.lit(";database=Db;pwd= ;uid=x")))
        .when(F.col("k") == 2, F.lit("C:\\Data\\in")).when(F.col("k") == 3, F.lit("\\\\share\\out")).when(F.col("k") == 4, F.lit("dfgsdf"))
        .when(F.col("k") == 5, F.concat(F.lit("Server=old;Server="), server)).otherwise(F.col("c_mktsegment"))
    )
    return rows.select(F.col("c_custkey").alias("app_id"), F.col("c_name").alias("app_name"), F.concat(F.lit("Conn"), (F.col("c_custkey") % 3).cast("string")).alias("name"), value.alias("value"), F.col("k").isin(0, 4).alias("marked"))


#: Operations of events, by event type and number.
IO_OPERATIONS = ("File.Exists", "new HttpClient", "new PrintDocument", "new SerialPort", "Process.Start", "new SmtpClient", "MethodInfo.Invoke", "StreamWriter", "new ModbusClient")


def io_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as an input or output operation of its user."""
    rows = table(spark, sf_dir, "events", "event_id", "user_id")
    return rows.select(F.col("user_id").alias("app_id"), F.col("event_id").alias("id"), chosen(F.col("event_id") % len(IO_OPERATIONS), IO_OPERATIONS).alias("operation"))


#: A screen of an application, for each part: {p} its number, {q} the next part's, {k} the number of an overloaded helper.
SCREEN = """using System.Data.SqlClient;
using System.Windows.Forms;

namespace App.Screens
{
    public partial class Form{p} : Form {
        private Button btnSave;
        private Label lblName;
        private string title;

        public void Load(int id)
        {
            string sql = "SELECT A, B FROM Part_{p} WHERE id = " + id;
            SqlCommand cmd = new SqlCommand(sql, connection);
            cmd.Parameters.AddWithValue("@id", id);
            SqlDataReader reader = cmd.ExecuteReader();
            title = reader["A"].ToString() + reader["B"];
            Save();
            this.Helper(1);
            Inherited();
            Unheard();
        }

        private void Save()
        {
            SqlCommand command = new SqlCommand("SaveProc_{p}", connection);
            command.CommandType = CommandType.StoredProcedure;
            command.ExecuteNonQuery();
            File.WriteAllText(path, "x");
        }

        private void Branch()
        {
            string q = "SELECT 1 FROM T";
            if (flag)
                q = "SELECT 2 FROM U";
            SqlCommand c2 = new SqlCommand(q, connection);
        }

        private void Build()
        {
            StringBuilder sb = new StringBuilder();
            sb.Append("UPDATE Table_{p} ");
            sb.AppendLine(@"SET ""X"" = 1");
            sb.Append("WHERE id = " + id);
            SqlCommand c3 = new SqlCommand(sb.ToString(), connection);
            MethodInfo info = type.GetMethod("Run");
            info.Invoke(target, null);
        }

        private void Helper(int a)
        {
        }
{overload}
        private void InitializeComponent()
        {
            this.btnSave = new System.Windows.Forms.Button();
            this.btnSave.Text = "Save {p}";
            this.btnSave.Click += new System.EventHandler(this.btnSave_Click);
            this.btnSave.Enter += Save;
            this.btnSave.Leave += (s, e) => Save();
            this.odd = new System.Windows.Forms.Gauge();
        }

        private void btnSave_Click(object sender, EventArgs e)
        {
            Form{q} next = new Form{q}();
            next.ShowDialog();
            new Missing().Show();
            other.Show();
            MessageBox.Show("done");
        }
    }
}
"""
OVERLOAD = """
        private void Helper(string a)
        {
        }
"""
PROGRAM = """namespace App
{
    internal static class Program {
        private static void Main()
        {
            Application.Run(new Form{p}());
        }
    }
}
"""
SETTINGS_CLASS = """namespace App.Properties
{
    internal sealed partial class Settings
    {
        [ApplicationScopedSetting]
        [SpecialSetting(SpecialSetting.ConnectionString)]
        [DefaultSettingValue("Data Source=srv{p};Initial Catalog=Db")]
        public string Main{p}
        {
            get { return (string)this["Main{p}"]; }
        }

        [DefaultSettingValue("C:\\\\Data\\\\{p}")]
        public string Folder => (string)this["Folder"];
    }
}
"""
CONFIG = """<?xml version="1.0"?>
<configuration>
  <connectionStrings>
    <!-- <add name="Old" connectionString="server=old" /> -->
    <add name="Same" connectionString=" Data Source=srv{p};Initial Catalog=Db " />
    <add name="Other" connectionString="server=other{p}" />
    <add name="Empty" connectionString="" />
  </connectionStrings>
</configuration>
"""


#: A class of a part that opens connections in several ways, with braces on lines of their own: {p} its number.
REPOSITORY = """using System.Data.SqlClient;

namespace App.Data
{
    public class Store{p}
    {
        private static string shared = Settings.Default.Main{p};

        public void Direct()
        {
            // SqlConnection cn = new SqlConnection(old);
            using (SqlConnection cn = new SqlConnection(Properties.Settings.Default.Main{p}))
            {
                SqlCommand cmd = new SqlCommand("UPDATE Direct_{p} SET A = 1", cn);
                cmd.ExecuteNonQuery();
            }
        }

        public void Passed(bool log)
        {
            string cs = "x";
            string other = cs;
            cs = Settings.Default.Main{p};
            if (log)
                Trace(cs);
            SqlConnection cn = new SqlConnection();
            cn.ConnectionString = cs;
            SqlCommand cmd = cn.CreateCommand();
            cmd.CommandText = "INSERT INTO Passed_{p} (A) VALUES (1)";
        }

        public void Choice(bool test)
        {
            SqlConnection cn = new SqlConnection(test ? Settings.Default.Main{p} : Settings.Default.Other);
            SqlCommand cmd = new SqlCommand("SELECT A FROM Choice_{p}", cn);
        }

        public void Branches(int mode)
        {
            string cs;
            if (mode == 1)
            {
                cs = Settings.Default.Main{p};
            }
            else if (mode == 2)
                cs = Settings.Default.Other;
            else
            {
                return;
            }
            SqlConnection cn = new SqlConnection(cs);
            SqlCommand cmd = new SqlCommand("DELETE FROM Branches_{p} WHERE A = 1", cn);
        }

        public void Guarded(int mode)
        {
            string cs = Settings.Default.Other;
            if (mode == 1)
            {
                cs = Settings.Default.Main{p};
            }
            else
            {
                throw new Exception("no mode; {none}");
            }
            SqlCommand cmd = new SqlCommand();
            cmd.CommandText = "SELECT A FROM Guarded_{p}";
            cmd.Connection = new SqlConnection(cs);
        }

        public void Shared()
        {
            SqlCommand cmd = new SqlCommand("SELECT A FROM Shared_{p}", new SqlConnection(shared));
        }

        public void Written()
        {
            SqlConnection cn = new SqlConnection("Server=lab{p};Database=Lab");
            SqlCommand cmd = new SqlCommand("SELECT A FROM Written_{p}", cn);
        }

        public void Built(string host)
        {
            OracleConnection cn = new OracleConnection("Data Source=" + host);
            OracleCommand cmd = new OracleCommand("SELECT A FROM Built_{p}", cn);
        }

        public void Ledger()
        {
            OracleCommand cmd = new OracleCommand("SELECT A FROM GL_LINES", new OracleConnection(Settings.Default.Other));
        }
    }
}
"""


#: A window of a part, defined in markup, with a class inside it and braces on lines of their own: {p} its number.
WINDOW = """using System.Windows;

namespace App.Views
{
    public partial class Main{p} : Window
    {
        private Detail detail = new Detail();

        public void Open()
        {
            if (ready)
            {
                Detail{p} view = new Detail{p}();
                view.ShowDialog();
            }
            Refresh();
        }

        private class Detail : Base, IItem
        {
            public void Refresh()
            {
                Inner();
            }

            private void Inner() { Count(); }
        }

        private void Refresh()
        {
        }
    }
    public class Detail{p} : System.Windows.Window
    {
    }
}
"""


def window_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``WINDOW`` for each part; an application is a brand."""
    parts = spread(table(spark, sf_dir, "part", "p_partkey", "p_brand")).select(F.col("p_brand").alias("app_name"), F.col("p_partkey").cast("string").alias("p"))
    return parts.select("app_name", F.concat(F.lit("Views/Main"), "p", F.lit(".xaml.cs")).alias("path"), F.replace(F.lit(WINDOW), F.lit("{p}"), F.col("p")).alias("text"))


def repository_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``REPOSITORY`` for each part, of the application that ``settings_files`` has its settings for."""
    parts = spread(table(spark, sf_dir, "part", "p_partkey")).select(F.col("p_partkey").cast("string").alias("p"))
    return parts.select(F.concat(F.lit("App"), "p").alias("app_name"), F.lit("Data/Store.cs").alias("path"), F.replace(F.lit(REPOSITORY), F.lit("{p}"), F.col("p")).alias("text"))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A screen for each part; a program for every tenth; an application is a brand."""
    parts = spread(table(spark, sf_dir, "part", "p_partkey", "p_brand")).select(F.col("p_brand").alias("app_name"), F.col("p_partkey").alias("p"))

    def filled(text: str) -> Column:
        text = F.replace(F.lit(text), F.lit("{overload}"), F.when(F.col("p") % 2 == 0, OVERLOAD).otherwise(""))
        return F.replace(F.replace(text, F.lit("{p}"), F.col("p").cast("string")), F.lit("{q}"), (F.col("p") + 1).cast("string"))

    screens = parts.select("app_name", F.concat(F.lit("Screens/Form"), F.col("p").cast("string"), F.lit(".cs")).alias("path"), filled(SCREEN).alias("text"))
    programs = parts.filter("p % 10 = 0").select("app_name", F.concat(F.lit("Program"), F.col("p").cast("string"), F.lit(".cs")).alias("path"), filled(PROGRAM).alias("text"))
    return screens.unionByName(programs)


def settings_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Settings classes and configuration files of each part; every fifth configuration is cut off."""
    parts = spread(table(spark, sf_dir, "part", "p_partkey")).select(F.concat(F.lit("App"), F.col("p_partkey").cast("string")).alias("app_name"), F.col("p_partkey").alias("p"))
    number = F.col("p").cast("string")
    code = parts.select("app_name", F.lit("Properties/Settings.cs").alias("path"), F.replace(F.lit(SETTINGS_CLASS), F.lit("{p}"), number).alias("text"))
    text = F.replace(F.lit(CONFIG), F.lit("{p}"), number)
    return code, parts.select("app_name", F.lit("app.config").alias("path"), F.when(F.col("p") % 5 == 0, F.left(text, F.lit(120))).otherwise(text).alias("text"))
