"""The suffix sorter (SuffixGroups.java) as a SQL function.

Sorting suffixes by grouping is one long dependent loop per text, so it runs in the JVM. The source is
compiled when first asked for by the Java compiler inside Spark's own jars and handed to the
executors as a jar in the shared folder.
"""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from docproof.llm._common import shared_dir

SOURCE = Path(__file__).with_name("SuffixGroups.java")
_ready: set[tuple[str, int]] = set()
_loaders: dict[str, object] = {}


def _loader(spark: SparkSession):
    """A class loader with the compiled class; the executors get the class as a jar."""
    app = spark.sparkContext.applicationId
    if app not in _loaders:
        jvm = spark._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(SOURCE.read_text())
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as jar:
            for name, code in dict(compiler.getBytecodes()).items():
                jar.writestr(f"{name.replace('.', '/')}.class", bytes(code))
        path = f"{shared_dir(spark, 'jar')}/suffix-groups.jar"
        where = jvm.org.apache.hadoop.fs.Path(path)
        out = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(where)
        out.write(data.getvalue())
        out.close()
        spark.sparkContext._jsc.sc().addJar(path)
        _loaders[app] = compiler.getClassLoader()
    return _loaders[app]


def register(spark: SparkSession, length: int) -> str:
    """The function's name: (text, ends) -> one class number for each byte (see SuffixGroups)."""
    name = f"suffix_classes_{length}"
    session = spark._jsparkSession.sessionUUID()
    if (session, length) not in _ready:
        jvm = spark._jvm
        made = _loader(spark).loadClass("docproof.SuffixGroups").getConstructors()[0]
        arguments = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 1)
        arguments[0] = length
        spark._jsparkSession.udf().register(name, made.newInstance(arguments), jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
        _ready.add((session, length))
    return name
