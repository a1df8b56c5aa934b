"""docketry: loan-document screening, scoring and reporting as Spark DataFrame operators."""
