"""framelake: in-situ microscopy analysis and corpus preparation as Spark DataFrame operators."""
