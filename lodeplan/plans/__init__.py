"""From a request to a checked pipeline: no module here touches a SparkSession."""
