"""tickframe: compositional dataflow and time-stepped state, as Spark plans."""
