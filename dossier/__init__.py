"""dossier: document analytics and retrieval as lazy PySpark plans."""
