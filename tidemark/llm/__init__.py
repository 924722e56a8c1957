"""Operations for building large language-model training corpora on Spark.

Nothing outside this subpackage imports it; the subpackage can be removed as a whole.
"""
