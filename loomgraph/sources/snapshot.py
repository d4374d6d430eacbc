"""Snapshot folders of cluster objects, evaluation records and question sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.sources import arrays

META = (
    "metadata struct<name:string,uid:string,namespace:string,resourceVersion:string,creationTimestamp:string,"
    "labels:map<string,string>,annotations:map<string,string>,"
    "ownerReferences:array<struct<kind:string,name:string,uid:string>>,managedFields:array<struct<manager:string>>>"
)
_CONTAINERS = "array<struct<name:string,image:string,resources:struct<requests:map<string,string>,limits:map<string,string>>>>"
_REPLICAS = "spec struct<replicas:int>, status struct<replicas:int,readyReplicas:int>"

# The files of a snapshot folder and the fields read from them.
SCHEMAS: dict[str, tuple[str, str]] = {
    "Cluster": ("cluster", f"{META}, name string, cluster_url string, info struct<gitVersion:string,major:string,minor:string>"),
    "Namespace": ("namespaces", f"{META}, status struct<phase:string>"),
    "Pod": (
        "pods",
        f"{META}, spec struct<nodeName:string,containers:{_CONTAINERS},initContainers:{_CONTAINERS},"
        "volumes:array<struct<name:string,persistentVolumeClaim:struct<claimName:string>>>>, "
        "status struct<phase:string,podIP:string,containerStatuses:array<struct<name:string,ready:boolean,restartCount:int,"
        "lastState:struct<terminated:struct<reason:string,exitCode:int,message:string,finishedAt:string>>>>>",
    ),
    "Deployment": ("deployments", f"{META}, {_REPLICAS}"),
    "StatefulSet": ("statefulsets", f"{META}, {_REPLICAS}"),
    "ReplicaSet": ("replicasets", f"{META}, {_REPLICAS}"),
    "DaemonSet": ("daemonsets", f"{META}, status struct<desiredNumberScheduled:int,numberReady:int>"),
    "Job": ("jobs", f"{META}, status struct<active:int,succeeded:int,failed:int>"),
    "Ingress": (
        "ingresses",
        f"{META}, spec struct<rules:array<struct<host:string,http:struct<paths:array<struct<path:string,"
        "backend:struct<service:struct<name:string,port:struct<number:int,name:string>>>>>>>>>",
    ),
    "Service": ("services", f"{META}, spec struct<type:string,clusterIP:string,selector:map<string,string>>"),
    "EndpointSlice": (
        "endpointslices",
        f"{META}, addressType string, endpoints array<struct<addresses:array<string>,"
        "conditions:struct<ready:boolean,serving:boolean,terminating:boolean>,hostname:string,nodeName:string,zone:string,"
        "hints:struct<forZones:array<struct<name:string>>>,"
        "targetRef:struct<kind:string,name:string,namespace:string,uid:string,resourceVersion:string>>>",
    ),
    "NetworkPolicy": ("networkpolicies", META),
    "ConfigMap": ("configmaps", f"{META}, data map<string,string>"),
    "StorageClass": ("storageclasses", f"{META}, provisioner string"),
    "PersistentVolume": (
        "persistentvolumes",
        f"{META}, spec struct<storageClassName:string,claimRef:struct<uid:string,name:string,namespace:string>>",
    ),
    "PersistentVolumeClaim": ("persistentvolumeclaims", f"{META}, spec struct<storageClassName:string>, status struct<phase:string>"),
    "Node": ("nodes", f"{META}, status struct<capacity:map<string,string>>"),
    "ServiceAccount": ("serviceaccounts", META),
    "Event": (
        "events",
        f"{META}, type string, reason string, note string, eventTime string, "
        "regarding struct<kind:string,name:string,namespace:string,uid:string>",
    ),
}
CLUSTER_WIDE = ("Cluster", "Namespace", "StorageClass", "PersistentVolume", "Node")
OPTIONAL = ("Node", "StorageClass", "PersistentVolume", "PersistentVolumeClaim")
#: The column with an object's place in its source, by which the last of several wins.
ORDINAL = "_at"
DROPPED_ANNOTATIONS = ("kubectl.kubernetes.io/last-applied-configuration", "kapp.k14s.io/original")


def schema_of(kind: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[kind][1])


def read_kind(spark: SparkSession, path: str, kind: str, *, format: str = "json", ordinals: bool = False) -> DataFrame:
    """One kind: ``json`` is a file with an array, ``ndjson`` and ``parquet`` are folders; all are read by many tasks.

    An array file of no more bytes than one task's range is left to Spark's reader. ``ordinals`` adds ``ORDINAL``.
    """
    name = SCHEMAS[kind][0]
    reader = spark.read.schema(schema_of(kind))
    if format == "json":
        file = f"{path}/{name}.json"
        found = arrays.file_size(spark, file)
        if found and found[1] > arrays.RANGE_BYTES:
            return arrays.read_array(spark, file, schema_of(kind), range_bytes=arrays.RANGE_BYTES, ordinal=ORDINAL if ordinals else None)
        df = reader.json(file, multiLine=True)
    else:
        df = reader.json(f"{path}/{name}") if format == "ndjson" else reader.parquet(f"{path}/{name}")
    return with_ordinal(df) if ordinals else df


def with_ordinal(df: DataFrame) -> DataFrame:
    """Add ``ORDINAL`` to a frame that is read from files: file, start of the block that a task reads, and a
    number that rises within the task. It sorts as the rows stand in the files, however these are cut into tasks."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.withColumn(ORDINAL, at)


def place(df: DataFrame) -> Column:
    """An object's place: its ``ORDINAL``, any sortable column, where there is one; else the order of the rows as they come."""
    return F.col(ORDINAL) if ORDINAL in df.columns else F.monotonically_increasing_id()


def read_snapshot(spark: SparkSession, path: str, *, namespace: str | None = None, format: str = "json", ordinals: bool = False) -> dict[str, DataFrame]:
    """Kind -> DataFrame of a snapshot folder.

    A missing file is an error, but for the four kinds in ``OPTIONAL``, which are empty then. With
    ``namespace`` the namespaced kinds are restricted to it; the filter reaches Parquet files. With ``ordinals`` each
    object keeps its place in the files, so that rules of the last one give the same graph for any split.
    """
    out = {}
    for kind in SCHEMAS:
        try:
            df = read_kind(spark, path, kind, format=format, ordinals=ordinals)
            df.schema  # the path is checked here  # noqa: B018
        except Exception as e:
            if kind not in OPTIONAL or "PATH_NOT_FOUND" not in str(e):
                raise
            out[kind] = spark.createDataFrame([], schema_of(kind))
            continue
        out[kind] = df if namespace is None or kind in CLUSTER_WIDE else df.where(F.col("metadata.namespace") == namespace)
    return out


def cleanup_metadata(df: DataFrame) -> DataFrame:
    """Drop the managed fields and the two annotations that only repeat the object."""
    annotations = F.map_filter("metadata.annotations", lambda k, _: ~k.isin(*DROPPED_ANNOTATIONS))
    return df.withColumn("metadata", F.col("metadata").withField("annotations", annotations).dropFields("managedFields"))


EVALUATION = (
    "model string, question_id string, run_index int, mode string, "
    "attempts array<struct<attempt:int,valid:boolean,error:string,cypher:string,tokens:struct<prompt:int,output:int,total:int>>>, "
    "final struct<valid:boolean,error:string,cypher:string,rows:int,execution_error:string,result_match:boolean>, "
    "metrics struct<attempts:int,latency_ms:int,total_tokens:int,total_prompt_tokens:int,total_output_tokens:int>"
)


def read_evaluations(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation records, one JSON object a line; blank and malformed lines are skipped."""
    return spark.read.schema(EVALUATION).option("mode", "DROPMALFORMED").json(path).where("model is not null")


QUESTION = "struct<id:string,question:string,tags:array<string>,deterministic:boolean,reference_cypher:string>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A question set as JSON: a list, or groups of lists, whose questions get the tag ``difficulty:<group>``.

    An empty set is an error.
    """
    text = spark.read.text(path, wholetext=True)
    grouped = F.from_json("value", f"map<string,array<{QUESTION}>>")
    is_list = F.ltrim("value").startswith("[")
    groups = text.select(
        F.when(is_list, F.create_map(F.lit(""), F.from_json("value", f"array<{QUESTION}>"))).otherwise(grouped).alias("g")
    ).select(F.explode("g").alias("difficulty", "qs"))
    rows = groups.select("difficulty", F.inline("qs"))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    tags = F.when(F.col("difficulty") == "", tags).otherwise(F.array_append(tags, F.concat(F.lit("difficulty:"), "difficulty")))
    out = rows.withColumn("tags", tags).drop("difficulty")
    if out.isEmpty():
        raise ValueError(f"no questions in {path}")
    return out
