"""Session settings that suit this library.

    builder = SparkSession.builder
    for key, value in SESSION_SETTINGS.items():
        builder = builder.config(key, value)

Results do not depend on them.
"""

from __future__ import annotations

SESSION_SETTINGS = {
    # Join and shuffle plans follow the sizes met at run time.
    "spark.sql.adaptive.enabled": "true",
    # One scan generates hundreds of classes; the default cache keeps 100.
    "spark.sql.codegen.cache.maxEntries": "2000",
    # The JVM does not compile methods above 8000 bytes; Spark should split them
    # before that.  Clones of wide tables are several times faster for it.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Planning makes thousands of column expressions; do not record where each was made.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}
