"""What the checking SQL of postings expects, held apart from the operators."""

# Names whose inside is never spaced and whose spelling is restored.
NAMES = [
    "Microsoft Entra ID", "Azure Active Directory", "Active Directory", "Sentence Transformers",
    "Sentence-Transformers", "SentenceTransformers", "Google Workspace", "Windows/Linux", "TCP/IP", "DNS/DHCP",
    "PowerShell/Bash", "PowerShell", "Bash", "Next.js", "Node.js", "Vue.js", "PyTorch Lightning", "Deep Learning",
    "Machine Learning", "Computer Vision", "Semantic Search", "Recommendation Systems", "Information Retrieval",
    "Recommender Systems", "Distributed Training", "GitHub", "GitLab", "CrowdStrike", "CrowdStrike Defender",
    "TensorFlow", "JavaScript", "TypeScript", "MongoDB", "PostgreSQL", "FastAPI", "OpenCV", "PyTorch", "Keras",
    "ChromaDB", "DynamoDB", "CompTIA", "CCNA", "PMP", "Scrum Master", "CI/CD", "LoRA", "PEFT",
    "Natural Language Processing", "NodeJS", "NextJS", "VueJS", "ReactJS", "Salesforce",
]

# Headers that start a line of their own.
HEADERS = [
    "Role:", "Job Title:", "Position Title:", "Company:", "Location:", "Employment Type:", "Type:", "Job Type:",
    "Role Overview:", "Role Overview", "Overview:", "Key Responsibilities:", "Key Responsibilities",
    "Responsibilities:", "Qualifications & Requirements:", "Qualifications & Requirements",
    "Required Qualifications:", "Required Qualifications", "Technical Requirements:", "Technical Requirements",
    "Technical Skills:", "Technical Skills", "Education qualification:", "Education qualification",
    "Education Qualification:", "Education Qualification", "Education:", "Experience Required:", "Experience:",
    "Yrs of experience:", "Yrs of experience", "Years of experience:", "Years of experience", "Certifications:",
    "Certifications", "Workplace Skills:", "Key Performance Indicators", "KPIs", "Who are we looking for?",
    "Who are we looking for", "Must have:", "Must have", "Must Have:", "Must Have", "Primary Skills:",
    "Primary Skills", "Secondary Skills:", "Secondary Skills", "Preferred Skills:", "Preferred Skills",
    "Preferred Qualifications:", "Preferred Qualifications", "Nice to have:", "Nice to have", "Good to have:",
    "Good to have", "ASR Development:", "Computer Vision:", "Multimodal Fusion:", "Performance Optimization:",
    "Data Pipelines:", "Evaluation:",
]
