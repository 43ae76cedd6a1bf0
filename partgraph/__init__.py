"""partgraph: automotive part-logistics tables as Spark DataFrame plans."""
