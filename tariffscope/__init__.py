"""tariffscope: utility-bill auditing as Spark DataFrame jobs."""
