"""corpusloom: document retrieval, evidence and corpus analytics expressed as Spark plans."""
