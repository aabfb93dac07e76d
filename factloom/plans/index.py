"""An index: the eleven fact families of one code base, from source or from persisted artifacts, and checks on them.

Families are frames under the schemas of ``sources.facts``. The flat facts that ``Repo`` derives its relations from are a
view over them, so that a repository works the same from source and from artifacts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract import index_facts
from ..extract.python_facts import SCHEMA
from ..operators import hierarchy
from ..operators.graph import Levels
from ..operators.relations import AttributeFacts, ClassFacts, DecoratorFacts, ErrorFacts, FlowFacts, FunctionFacts, ImportFacts, SymbolFacts
from ..sources import facts as source

_PLACE = ("file", "line")


class InvalidIndex(RuntimeError):
    """The index breaks an invariant that queries rely on."""


class Index:
    def __init__(self, spark: SparkSession, families: dict[str, DataFrame]):
        self.spark, self._families = spark, families

    @classmethod
    def of_sources(cls, files: DataFrame, file: str = "file", text: str = "source") -> Index:
        """Extracts all families in one pass over (file, source) rows. The records are written to the shared folder, by family, so
        that no relation parses a file again; ``completed`` fills in the hierarchies."""
        spark = files.sparkSession
        at = Levels(spark, "facts").at
        index_facts.extract_records(files, file, text).write.partitionBy("family").parquet(at)
        records = spark.read.schema(index_facts.SCHEMA).parquet(at)
        families = {f: index_facts.family(records, f).drop("ord") for f in source.FAMILIES}
        return cls(files.sparkSession, families)

    @classmethod
    def of_artifacts(cls, spark: SparkSession, folder: str) -> Index:
        """Reads persisted families; those that the folder lacks are empty. Fails closed on damaged ones."""
        return cls(spark, source.read_index(spark, folder))

    @classmethod
    def empty(cls, spark: SparkSession) -> Index:
        return cls(spark, {})

    def family(self, name: str) -> DataFrame:
        if name not in self._families:
            self._families[name] = self.spark.createDataFrame([], source.schema_of(name))
        return self._families[name]

    def completed(self) -> Index:
        """With the classes' linear orders, subclasses and inherited methods filled in from all classes' bases."""
        classes = hierarchy.completed(self.family("classes"), source.schema_of("classes").names)
        return Index(self.spark, {**self._families, "classes": classes})

    def write(self, folder: str) -> None:
        """All families as JSONL, and the manifest of their sizes and schemas beside them."""
        for name in source.FAMILIES:
            source.write_family(self.family(name), folder, name)
        counts = source.manifest({f: self.family(f) for f in source.FAMILIES})
        counts.withColumn("schema", F.lit(source.schema_fingerprint())).coalesce(1).write.json(f"{folder}/manifest.jsonl")

    # --- typed relations --------------------------------------------------------------------------------------

    functions = property(lambda self: FunctionFacts(self.family("functions"), (*_PLACE, "fqn"), "functions"))
    classes = property(lambda self: ClassFacts(self.family("classes"), ("file", "fqn"), "classes"))
    decorators = property(lambda self: DecoratorFacts(self.family("decorators"), ("target_fqn", "application_order"), "decorators"))
    imports = property(lambda self: ImportFacts(self.family("imports"), ("location", "module"), "imports"))
    attributes = property(lambda self: AttributeFacts(self.family("attributes"), ("location", "attr_name"), "attributes"))
    flow = property(lambda self: FlowFacts(self.family("value_flow_edges"), ("source_location", "source_expr", "target_expr"), "flow"))
    symbols = property(lambda self: SymbolFacts(self.family("symbol_refs"), ("location", "name"), "symbols"))
    errors = property(lambda self: ErrorFacts(self.family("errors"), ("file", "pass_name", "message"), "errors"))

    # --- the flat view ----------------------------------------------------------------------------------------

    def flat(self) -> DataFrame:
        """All facts as rows of ``extract.python_facts.SCHEMA``."""
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = dict(c.split() for c in SCHEMA.split(", "))

        def rows(family: str, where: Column | None = None, df: DataFrame | None = None, **given: Column) -> DataFrame:
            df = self.family(family) if df is None else df
            place = {"file": F.col("location.file"), "line": F.col("location.line"), "column": F.col("location.column")}
            given = {**place, **given, "family": F.lit(family)}
            df = df if where is None else df.where(where)
            return df.select(*(given.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names))

        caller = lambda c: F.coalesce(F.col(c), F.lit("<module>"))
        called = F.nullif(F.regexp_extract("call_expression", r"^([A-Za-z_][\w.]*)\(", 1), F.lit(""))
        keyworded = F.transform("kwargs", lambda k: F.concat(k[0], F.lit("="), k[1]))
        text = F.transform("arguments", lambda a: F.when(a["keyword"].isNull(), a["expression"]).otherwise(F.concat(a["keyword"], F.lit("="), a["expression"])))
        alias = F.map_from_entries(F.transform("aliases", lambda a: F.struct(a[0], a[1])))
        each = F.when(F.col("is_from_import"), F.col("names")).otherwise(F.array("module"))
        imports = self.family("imports").withColumn("_name", F.explode(each)).withColumn("_alias", F.coalesce(F.try_element_at(alias, F.col("_name")), F.col("_name")))
        receiver = F.when(F.col("target_expr").rlike(r"^[A-Za-z_][\w.]*$"), F.concat("target_expr", F.lit("."), "attr_name"))
        parts = [
            rows("functions", file=F.col("file"), line=F.col("line"), fqn=F.col("fqn"), name=F.col("name"), owner=F.coalesce("parent_class", "parent_function", F.lit("<module>")), detail=F.array_join(F.col("params.name"), ","), flag=F.col("is_method")),
            rows("classes", file=F.col("file"), fqn=F.col("fqn"), name=F.col("name"), detail=F.array_join("bases", ",")),
            rows("decorators", fqn=F.col("fqn"), name=F.col("name"), target=F.col("target_fqn"), detail=F.array_join(F.concat("args", keyworded), ", ")),
            rows("imports", df=imports, fqn=F.when(F.col("is_from_import"), F.concat("module", F.lit("."), "_name")).otherwise(F.col("module")), name=F.col("_alias"), flag=F.col("is_from_import")),
            rows("call_edges", fqn=F.coalesce(called, F.col("callee_fqn")), name=F.substring_index(F.coalesce(called, F.col("callee_fqn")), ".", -1), owner=F.col("caller_fqn"), target=F.col("callee_fqn"), detail=F.array_join(text, ",")),
            rows("attributes", F.col("access_kind").isin("ATTR", "DEL"), fqn=receiver, name=F.col("attr_name"), owner=caller("containing_function_fqn"), target=F.col("target_expr"), flag=F.col("is_write")),
            rows("value_flow_edges", F.col("kind") != "TRANSFORM_INPUT", file=F.col("source_location.file"), line=F.col("source_location.line"), column=F.col("source_location.column"), name=F.col("source_expr"), owner=caller("containing_function_fqn"), target=F.col("target_expr"), detail=F.lower("kind")),
            rows("errors", file=F.col("file"), name=F.col("error_kind"), detail=F.col("message"), flag=F.col("is_fatal")),
        ]
        return reduce(DataFrame.unionByName, parts)

    # --- invariants -------------------------------------------------------------------------------------------

    def violations(self) -> DataFrame:
        """``family``, ``rule``, ``subject``, ``blocking``: paths that are not relative, names that are not canonical, edges and
        decorators without the function they name, graphs without an entry."""
        bad_path = lambda c: F.col(c).isNull() | F.col(c).startswith("/") | F.col(c).rlike(r"(^|/)\.\.(/|$)")
        bad_name = lambda c: F.col(c).isNull() | ~F.col(c).rlike(r"^[^\s.]+(\.[^.]+)*$")
        functions = self.family("functions")
        known = functions.select("fqn").union(self.family("classes").select("fqn")).distinct()
        mark = lambda df, family, rule, subject, blocking: df.select(F.lit(family).alias("family"), F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"), F.lit(blocking).alias("blocking"))
        orphans = self.family("decorators").join(known.withColumnRenamed("fqn", "target_fqn"), "target_fqn", "left_anti")
        callers = self.family("call_edges").where("caller_fqn != '<module>'").join(known.withColumnRenamed("fqn", "caller_fqn"), "caller_fqn", "left_anti")
        graphs = functions.where("kind != 'LAMBDA'").join(self.family("cfgs").select("fqn").distinct(), "fqn", "left_anti")
        parts = [
            mark(functions.where(bad_path("file")), "functions", "relative path", "file", True),
            mark(functions.where(bad_name("fqn")), "functions", "canonical name", "fqn", True),
            mark(self.family("classes").where(bad_path("file")), "classes", "relative path", "file", True),
            mark(self.family("classes").where(bad_name("fqn")), "classes", "canonical name", "fqn", True),
            mark(orphans, "decorators", "known target", "target_fqn", False),
            mark(callers, "call_edges", "known caller", "caller_fqn", False),
            mark(graphs, "cfgs", "graph of each function", "fqn", False),
        ]
        return reduce(DataFrame.union, parts)

    def blocking_violations(self) -> DataFrame:
        return self.violations().where("blocking")

    def checked(self) -> Index:
        """The index itself; raises with the first few violations that block."""
        found = self.blocking_violations().limit(5).collect()
        if found:
            raise InvalidIndex("; ".join(f"{r['family']}: {r['rule']}: {r['subject']}" for r in found))
        return self
