"""Weekly health reports over a fleet of refrigeration devices, as Spark DataFrame operators."""
