"""helixframe: DataFrame operators for sequences, intervals, pileups and variants on Spark."""
