"""pacegrid: ranked-contest analytics as Spark DataFrame operators."""
